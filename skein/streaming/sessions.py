"""Session carry-forward with first-in, first-out eviction kept in the state of the stream itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.streaming.state import with_keyed_state

_OUT = "desk string, session string, turn long, case_id long, began boolean"


class _Desk(StatefulProcessor):
    """The sessions of one desk: each with its last case, number of turns and last time, and the order in which they began."""

    def __init__(self, most: int, turns: int, idle_ms: int):
        self.most, self.turns, self.idle_ms = most, turns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session string", "last long, n long, seen long, born long")
        self.order = handle.getMapState("order", "born long", "session string")
        self.ends = handle.getValueState("ends", "oldest long, next long, size long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([x.convert_dtypes() for x in rows]).sort_values(["ms", "session", "turn"], kind="stable")
        oldest, next_, size = self.ends.get() if self.ends.exists() else (0, 0, 0)
        out, due = [], set()
        for session, turn, case, now in zip(pdf["session"], pdf["turn"], pdf["case_id"], pdf["ms"], strict=True):
            held = self.sessions.getValue((session,)) if self.sessions.containsKey((session,)) else None
            last, n, seen, born = held or (None, 0, None, None)
            if held and (n >= self.turns or now - seen > self.idle_ms):
                last, n = None, 0
            began = n == 0
            if born is None:
                if size >= self.most:  # the session that began first goes; places of ended ones are skipped
                    while not self.order.containsKey((oldest,)):
                        oldest += 1
                    self.sessions.removeKey(self.order.getValue((oldest,)))
                    self.order.removeKey((oldest,))
                    oldest, size = oldest + 1, size - 1
                born, next_, size = next_, next_ + 1, size + 1
                self.order.updateValue((born,), (session,))
            last = last if pd.isna(case) else int(case)
            seen = int(now) if seen is None else max(seen, int(now))
            self.sessions.updateValue((session,), (last, n + 1, seen, born))
            due.add(seen + self.idle_ms)
            out.append((key[0], session, int(turn), last, began))
        self.ends.update((oldest, next_, size))
        mark = timerValues.getCurrentWatermarkInMs()
        for t in due:
            self.handle.registerTimer(max(t, mark) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"case_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Sessions that have been idle by event time end; there are `most` at the most."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(s, v[3]) for s, v in self.sessions.iterator() if now - v[2] > self.idle_ms]
        if gone:
            oldest, next_, size = self.ends.get()
            for session, born in gone:
                self.sessions.removeKey(session)
                self.order.removeKey((born,))
            self.ends.update((oldest, next_, size - len(gone)))
        return iter(())

    def close(self) -> None:
        pass


def desk_sessions(turns: DataFrame, most: int = 500, keep: int = 100, idle: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(desk, session, turn, case_id, began) of a stream (desk, session, turn, case_id, ts): each turn with its own case or the
    last one of its session.

    A desk holds `most` sessions; the one that began first is evicted when another begins, and starts anew if it comes back. A
    session ends after `idle` in event time and starts anew after `keep` turns. Rows of a micro-batch are taken by time, session and
    turn. Null desks share one; rows without session or time are left out. Desks run side by side, a desk's order is its own."""
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = turns.where("session is not null and ts is not null").select(F.coalesce(F.col("desk").cast("string"), F.lit("")).alias("desk"), "session", F.col("turn").cast("long"), F.col("case_id").cast("long"), "ts", F.unix_millis("ts").alias("ms"))
    with_keyed_state(turns.sparkSession)
    return rows.withWatermark("ts", late).groupBy("desk").transformWithStateInPandas(_Desk(most, keep, pause), _OUT, "Append", "EventTime")
