"""Chat formatting with a grammar round trip (operator 8).

Grammar of the output, one segment a turn, with no text between segments:

    conversation := segment*
    segment      := "[INST]" body "[/INST]"                  role user
                  | "[SYS]" body "[/SYS]"                    role system
                  | "<s>" body "</s>"                        role assistant, under the loss mask
                  | "[ROLE]" name "[TEXT]" body "[/ROLE]"    any other role

No mark has another one's start inside it, so no mark can arise where a body and a mark meet.

Every segment is read back by a deterministic parser (one left-to-right scan for marks) and compared
to its source. A turn whose text comes back changed has its conflicting content escaped, a backslash
before each mark or backslash, and is read back again; this ends, as escaped text holds no bare mark.

Turns are rendered independently, whatever the length of a conversation. Reading back walks the
segments of each conversation in order, sorted on disk by Spark, and keeps one open turn in memory.

Defined cases: rows are ordered by turn, then role and text (nulls first); a null text is empty; a
null role is the empty role; a null conv_id is a conversation of its own; repeated rows are turns of
their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import texts

#: Marks of the template.
OPENS = {"user": "[INST]", "system": "[SYS]", "assistant": "<s>"}
CLOSES = {"user": "[/INST]", "system": "[/SYS]", "assistant": "</s>"}
OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE = "[ROLE]", "[TEXT]", "[/ROLE]"
_MARKS = sorted({*OPENS.values(), *CLOSES.values(), OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE}, key=len, reverse=True)
_MARK = re.compile("|".join(map(re.escape, _MARKS)))
# an escaped backslash or mark, or a bare mark
_TOKEN = re.compile(rf"\\(\\|{_MARK.pattern})|({_MARK.pattern})")
_CONFLICT = re.compile(rf"\\|{_MARK.pattern}")


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _TOKEN.sub(lambda m: m[1] or m[0], text)


def _parts(role: str) -> tuple[str, str]:
    if role in OPENS:
        return OPENS[role], CLOSES[role]
    return OTHER_OPEN + escape(role) + OTHER_MIDDLE, OTHER_CLOSE


class Parser:
    """Reads segments back: feed() gives the (role, text, masked) turns that are complete."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str, bool]]:
        text, at = self.rest + text, 0
        while at < len(text):
            got = self._turn(text, at)
            if got is None:
                break
            role, body, at = got
            yield role, body, role == "assistant"
        self.rest = text[at:]

    def _turn(self, text: str, at: int) -> tuple[str, str, int] | None:
        for role, mark in OPENS.items():
            if text.startswith(mark, at):
                body = self._until(text, at + len(mark), CLOSES[role])
                return body and (role, *body)
        if not text.startswith(OTHER_OPEN, at):
            raise ValueError(f"no turn starts at {text[at : at + 20]!r}")
        name = self._until(text, at + len(OTHER_OPEN), OTHER_MIDDLE)
        body = name and self._until(text, name[1], OTHER_CLOSE)
        return body and (name[0], *body)

    @staticmethod
    def _until(text: str, at: int, mark: str) -> tuple[str, int] | None:
        """(unescaped text, where the mark ends) of the first bare `mark`."""
        for m in _TOKEN.finditer(text, at):
            if m[2] == mark:
                return unescape(text[at : m.start()]), m.end()
        return None


def read_back(segment: str) -> list[tuple[str, str]] | None:
    parser = Parser()
    try:
        turns = [(role, text) for role, text, _ in parser.feed(segment)]
    except ValueError:
        return None
    return None if parser.rest else turns


def render_turn(role: str, text: str) -> str:
    """The segment of one turn, escaped only if its plain form would not come back as it was."""
    before, after = _parts(role)
    for body in (text, escape(text)):
        segment = before + body + after
        if read_back(segment) == [(role, text)]:
            return segment
    raise AssertionError("an escaped turn always comes back")


def formatted(conversations: DataFrame) -> DataFrame:
    """Per turn: conv_id, turn, role, text and its segment of the formatted conversation."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [render_turn(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, "segment"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(fn, "conv_id long, turn long, role string, text string, segment string")


def recovered(segments: DataFrame) -> DataFrame:
    """What the formatted text of each conversation holds, read back from it: conv_id, n_turns,
    turns_sha256 (role, line end, text, line end of each turn), loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close() -> None:
            if state is not None:
                conv, parser, n, turns, loss_chars, loss, chars = state
                if parser.rest:
                    raise ValueError(f"conversation {conv} ends inside a turn")
                done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            for conv, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, Parser(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[6] += len(segment)
                for role, text, masked in state[1].feed(segment):
                    state[2] += 1
                    state[3].update(f"{role}\n{text}\n".encode())
                    if masked:
                        state[4] += len(text)
                        state[5].update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    n = texts.blocks_for(segments.agg(F.sum(F.octet_length("text"))).first()[0], 8 << 20)
    rows = segments.repartition(texts.partitions_for(n, segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "segment").mapInArrow(fn, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return recovered(formatted(rows.unionByName(hard)))


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 m AS (SELECT *, CASE WHEN conv_id = -1 THEN 3 ELSE 0 END AS escapes,
   CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(text) + marks + escapes) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
