"""Harmonic packing (operator 4).

Piece lengths are the capacity's reciprocal parts: capacity // i for i = 1, 2, 3, ... A document's ids
are cut into the largest such length that fits, then the next, to the end, so a piece fills its
place exactly. A class of length s fills each bin with the fixed number capacity // s of pieces, and
a piece's bin follows from its rank in the class: workers count on their own, a small table of
counts by worker and class gives each its first rank, and no piece moves. Only what remains of
each class, less than one bin, is packed by first fit decreasing; this is bounded by the capacity.

Defined cases: a null or empty text is its end id alone; rows with one id are packed each; a null id
is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from skein.llm import texts, tokens
from skein.session import Scratch

PIECES = "part int, size int, rank long, doc_id long, start long, ids_crc32 long, doc_tokens long, ids binary"


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return out


def _pieces(tokenizer: str, end: int, capacity: int, with_ids: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.encoder(tokenizer)
        part, ranks = TaskContext.get().partitionId(), {}
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            data, offsets = texts.buffers(batch.column(1))
            for lo, hi in texts.pieces(batch.num_rows, offsets, 1 << 20):
                rows = []
                ids, at = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids = ids.astype("<u4")
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    raw = ids[a:b].tobytes() + last
                    n, start = len(raw) // 4, 0
                    for s in cuts(n, capacity):
                        r = ranks[s] = ranks.get(s, -1) + 1
                        piece = raw[4 * start : 4 * (start + s)]
                        rows.append((part, s, r, doc, start, zlib.crc32(piece), n, piece if with_ids else None))
                        start += s
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "size", "rank", "doc_id", "start", "ids_crc32", "doc_tokens", "ids"])

    return fn


def _first_fit(capacity: int):
    def fn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("g", "ascending")])
        room: list[int] = []
        seq, off = [], []
        for s in table["size"].to_pylist():
            b = next((i for i, x in enumerate(room) if x >= s), len(room))
            if b == len(room):
                room.append(capacity)
            seq.append(b)
            off.append(capacity - room[b])
            room[b] -= s
        return pa.table({"size": table["size"], "g": table["g"], "bin": pa.array(seq, pa.int64()), "at": pa.array(off, pa.int64())})

    return fn


def packed_sequences(docs: DataFrame, tokenizer: str, end: int, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as little-endian unsigned 32-bit)."""
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    pieces = scratch.store(rows.mapInArrow(_pieces(tokenizer, end, capacity, with_ids), PIECES), "pieces")
    # one row for each worker and class
    counts = pieces.groupBy("part", "size").agg(F.count("*").alias("n"))
    by_class = W.partitionBy("size")
    counts = counts.select("part", "size", (F.sum("n").over(by_class.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(by_class).alias("total"))
    counts = scratch.store(counts, "counts")
    # one row for each class: the number of full bins, and of those of earlier classes
    full = F.expr(f"total div ({capacity} div size)")
    classes = counts.groupBy("size").agg(F.max("total").alias("total")).select("size", full.alias("full"))
    classes = classes.select("size", "full", (F.sum("full").over(W.orderBy(F.desc("size"))) - F.col("full")).alias("first"), F.sum("full").over(W.partitionBy()).alias("all"))
    placed = pieces.join(counts.drop("total"), ["part", "size"]).join(F.broadcast(classes), "size").withColumn("g", F.col("base") + F.col("rank"))
    m = F.expr(f"{capacity} div size")
    placed = placed.withColumn("bin", F.expr(f"g div ({capacity} div size)"))
    rest = placed.where("bin >= full").select("size", "g", F.lit(0).alias("one")).groupBy("one").applyInArrow(_first_fit(capacity), "size int, g long, bin long, at long")
    rest = F.broadcast(rest.withColumnsRenamed({"bin": "late_bin", "at": "late_at"}))  # less than one bin of each of at most 2 * sqrt(capacity) classes
    out = placed.join(rest, ["size", "g"], "left")
    late = F.col("late_bin").isNotNull()
    cols = ["doc_id", "start", F.col("size").cast("long").alias("length"), "ids_crc32", "doc_tokens"]
    cols += [F.when(late, F.col("all") + F.col("late_bin")).otherwise(F.col("first") + F.col("bin")).alias("sequence_id"), F.when(late, F.col("late_at")).otherwise(F.col("g") % m * F.col("size")).alias("offset")]
    return out.select(*cols, *(["ids"] if with_ids else []))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json", 1)
