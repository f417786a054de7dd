"""Windows and sessions as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def recent_counts(events: DataFrame, ts: str, group: str, kind: str, window: str = "30 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of (group, kind) in sliding windows, with late rows up to `late`."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), group, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, kind, "n")


SESSION = "session string, turn long, case_id long"


def session_context(turns: DataFrame, idle: str = "1 hour", keep: int = 100) -> DataFrame:
    """From rows (session, turn, case_id, ts): (session, turn, case_id), each turn with its own case or the session's last.

    A session that is idle for so long in event time is forgotten, and after `keep` turns it starts anew. Timeouts follow
    the watermark and not the clock, so a stream without new rows has nothing to do and a run can be repeated; a turn that
    comes before its session's timeout ran is held against the session's last one itself.
    latest_sessions() bounds the number of stored sessions."""
    pause_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n, seen = state.get if state.exists else (None, 0, None)
        # a session's turns of one micro-batch may come in several Arrow batches
        pdf = pd.concat([x.convert_dtypes() for x in batches]).sort_values(["turn", "ts"])
        out = []
        for turn, case, ts in zip(pdf["turn"], pdf["case_id"], pdf["ts"], strict=True):
            now = int(ts.timestamp() * 1000)
            if n >= keep or (seen is not None and now - seen > pause_ms):
                last, n = None, 0
            last, n, seen = (last if pd.isna(case) else int(case)), n + 1, max(now, seen or now)
            out.append((key[0], int(turn), last))
        state.update((last, n, seen))
        state.setTimeoutTimestamp(max(seen + pause_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "turn", "case_id"]).astype({"case_id": "Int64"})

    return turns.withWatermark("ts", idle).groupBy("session").applyInPandasWithState(step, SESSION, "last long, n long, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_sessions(turns: DataFrame, most: int = 500) -> DataFrame:
    """The turns of the `most` sessions that began last; older ones are evicted first in, first out."""
    began = turns.groupBy("session").agg(F.min("ts").alias("began")).orderBy(F.desc("began"), "session").limit(most)
    return turns.join(began.select("session"), "session", "left_semi")
