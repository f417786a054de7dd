"""Documents packed into blocks, and exchanges between blocks and hash shards.

Several operators below read every text more than once and look up hashes of its words among those
of all other texts. They pack the documents into blocks of a few MB once (one row a block, written
to the shared folder), so that later steps need no grouping, and they exchange packed arrays: a
block sends each shard one sorted array of hashes, and the shard answers with one bit an entry. As
a block is written before it is used, a task that runs again sends the same arrays in the same
order. The numbers of blocks and of shards follow the input.

Rows are dealt to blocks by their id and place. A place must not change when a task runs again, so a table whose
rows come out of a shuffle is stored first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm import texts
from skein.session import Scratch

BLOCK_BYTES = 8 << 20
PACKED = "block long, ids binary, known binary, tags binary, offsets binary, body binary"


#: Steps of a plan that take rows in the order in which files hold them.
_IN_ORDER = {"Project", "Filter", "Relation", "RelationV2", "LocalRelation", "LogicalRDD", "Union", "Generate"}


def settled(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """df itself where its plan only reads files row by row, so that every run of a task sees the same rows at the same places; else a stored copy."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steps = {found[1] for line in plan.splitlines() if (found := re.match(r"[\s:|+-]*(\w*)", line))}
    return df if steps <= _IN_ORDER else scratch.store(df, name)


def packed(docs: DataFrame, scratch: Scratch, each: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", name: str = "blocks") -> tuple[DataFrame, int]:
    """(blocks, their number); a null text counts as empty, `known` is 0 where the id is null."""
    docs = settled(docs.select(id_col, text_col), scratch, f"{name}_rows")
    n = texts.blocks_for(docs.agg(F.sum(F.octet_length(text_col))).first()[0], each)
    rows = docs.select(
        # by the row's place too, so that rows that repeat an id, or have none, are spread
        F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(n)).alias("block"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("binary").alias("text"),
        F.xxhash64(text_col).alias("tag"),
    )
    return scratch.store(rows.repartition(texts.partitions_for(n, docs.sparkSession), "block").groupBy("block").applyInArrow(_pack, PACKED), name), n


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by([("id", "ascending"), ("text", "ascending")])
    body, offsets = texts.buffers(table["text"])
    ids = table["id"].combine_chunks()
    known = np.asarray(ids.is_valid()).astype(np.uint8)
    return pa.table(
        {
            "block": pa.array([table["block"][0].as_py()], pa.int64()),
            "ids": [np.asarray(ids.fill_null(0)).astype("<i8").tobytes()],
            "known": [known.tobytes()],
            "tags": [np.asarray(table["tag"].combine_chunks()).astype("<i8").tobytes()],
            "offsets": [offsets.astype("<i8").tobytes()],
            "body": [body.tobytes()],
        }
    )


class Block:
    """One packed row, read again."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        #: Spark's xxhash64 of each text: with the id it finds the row again.
        self.tags = np.frombuffer(row["tags"], "<i8")
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.body = np.frombuffer(row["body"], np.uint8)

    def words(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        return texts.words(self.body, self.offsets, lower)


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            yield Block(row), row


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so a sorted array falls into slices."""
    with np.errstate(over="ignore"):
        return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def slices(h: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the non-empty slices of a sorted array."""
    if not len(h):
        return
    s = shard_of(h, shards)
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(s)], strict=True):
        yield int(s[a]), int(a), int(b)


def narrow(h: np.ndarray) -> bytes:
    """The low 40 bits of each entry. With the shard, which follows from the high bits, they tell hashes
    apart but for one in 2**40 / (entries of a shard), which does not change as the input grows."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def widen(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :5] = part
    return out.view("<u8").ravel()


def exchanged(sent: DataFrame, answer: Callable[[list[dict]], list[bytes]], scratch: Scratch, name: str) -> DataFrame:
    """What the shards answer to each block: rows (block, answers: array of (shard, mask)).

    sent: rows (shard, block, ...); answer(rows of one shard) gives a mask for each row.
    """

    def fn(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int64()), "mask": pa.array(answer(rows), pa.binary())})

    out = sent.groupBy("shard").applyInArrow(fn, "block long, shard long, mask binary")
    return scratch.store(out, name)


def with_answers(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Adds a column of (shard, mask) to each block; a block that no shard answered gets null."""
    return blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("shard", "mask")).alias(name)), "block", "left")


def unmasked(sizes: list[tuple[int, int, int]], answers: list[dict] | None, n: int) -> np.ndarray:
    """The bits of all shards, in the order of the array that was sliced."""
    by_shard = {a["shard"]: a["mask"] for a in answers or ()}
    out = np.zeros(n, bool)
    for s, a, b in sizes:
        if s in by_shard:
            out[a:b] = np.unpackbits(np.frombuffer(by_shard[s], np.uint8), count=b - a).astype(bool)
    return out
