"""Vector best-fit packing (operator 11).

A sequence has three capacities: tokens, documents (pieces), and attention cost, the sum of its pieces'
squared lengths. Pieces go longest first, each into the open sequence that has room under every
capacity and fits best: the smallest weighted dot-product of the piece with the residual capacities
(`dot`), or the smallest weighted norm of what would remain of them (`norm`). Both are planned, and the
plan with fewer sequences is taken.

Pieces of one length are alike, so the plan needs only the number of pieces of each length: sequences
with the same residuals form one group, and a group takes pieces of a length all at once. This gives
exactly the sequences of best fit piece by piece (a sequence that fits best fits even better once it has
the piece, so it takes the next ones too). Each step uses up a group or a length and at least halves a
group's residual tokens, so planning is bounded by the capacity, however many pieces there are.
Workers count pieces by length on their own; a piece's rank in its length then says its sequence
and place, and no piece moves.

Only documents longer than a sequence are cut: whole sequences from the end, the first piece is the rest.

Defined cases: a null or empty text is its end id alone; rows with one id are packed each; a null id
is kept; ties go to the sequence opened first; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from skein.llm import texts, tokens
from skein.session import Scratch

_PIECES = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacities:
    """What one sequence holds, and what each residual weighs, as a share of its capacity."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that fits an empty sequence."""
        return min(self.tokens, math.isqrt(self.attention))

    def vector(self, size: int) -> np.ndarray:
        return np.array([size, 1, size * size], np.int64)

    @property
    def full(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


def _dot(piece: np.ndarray, residual: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return residual @ (weights * piece)


def _norm(piece: np.ndarray, residual: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return ((residual - piece) ** 2) @ weights


SCORES = {"dot": _dot, "norm": _norm}


def best_fit(counts: dict[int, int], room: Capacities, score: str) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, number of sequences) for so many pieces of each length.

    A run (size, rank, sequence, each, at): the pieces of the length from this rank on go to the
    sequences from this one on, `each` to a sequence, the first at the offset `at`."""
    fits, share = SCORES[score], np.array(room.weights) / room.full.astype(float) ** 2
    residual = np.zeros((0, 3), np.int64)
    first, many = np.zeros(0, np.int64), []  # of each group: its first sequence, and how many it has
    runs, opened = [], 0

    def put(group: int, size: int, each: int, n: int, rank: int) -> None:
        """The first n sequences of a group get so many pieces each; the others stay as they are."""
        nonlocal residual, first
        runs.append((size, rank, int(first[group]), each, int(room.tokens - residual[group, 0])))
        if n < many[group]:
            residual, first = np.vstack([residual, residual[group]]), np.append(first, first[group] + n)
            many.append(many[group] - n)
            many[group] = n
        residual[group] -= each * room.vector(size)

    for size in sorted(counts, reverse=True):
        piece, left, rank = room.vector(size), counts[size], 0
        if size > room.longest or room.documents < 1:
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        while left:
            open_ = np.flatnonzero((residual >= piece).all(axis=1))
            if len(open_):
                s = fits(piece, residual[open_], share)
                best = open_[s == s.min()]
                group = int(best[np.argmin(first[best])])
            else:
                each = int((room.full // piece).min())
                group, n = len(many), -(-left // each)
                residual, first = np.vstack([residual, room.full]), np.append(first, opened)
                many.append(n)
                opened += n
            each = int((residual[group] // piece).min())
            n = min(many[group], left // each)
            if n:
                put(group, size, each, n, rank)
            else:  # the last pieces of the length do not use up one sequence
                each, n = left, 1
                put(group, size, each, 1, rank)
            left, rank = left - each * n, rank + each * n
    return runs, opened


def fewest(counts: dict[int, int], room: Capacities) -> list[tuple[int, int, int, int, int]]:
    """The runs of the plan with fewer sequences."""
    return min((best_fit(counts, room, score) for score in SCORES), key=lambda plan: plan[1])[0]


def _cut(tokenizer: str, end: int, longest: int, with_ids: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.encoder(tokenizer)
        part, ranks = TaskContext.get().partitionId(), {}
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            data, offsets = texts.buffers(batch.column(1))
            for lo, hi in texts.pieces(batch.num_rows, offsets, 1 << 20):
                ids, at = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids, rows = ids.astype("<u4"), []
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    raw = ids[a:b].tobytes() + last
                    n = len(raw) // 4
                    starts = [0, *range(n % longest or longest, n, longest)]
                    for i, (start, stop) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        r = ranks[stop - start] = ranks.get(stop - start, -1) + 1
                        piece = raw[4 * start : 4 * stop]
                        rows.append((part, stop - start, r, doc, i, start, zlib.crc32(piece), piece if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return fn


def _placed(runs: list[tuple[int, int, int, int, int]], with_ids: bool):
    """Looks up each piece's run by its length and rank."""
    runs = sorted(runs)
    sizes = np.array([r[0] for r in runs], np.int64)
    ranks, sequences, each, at = (np.array([r[i] for r in runs], np.int64) for i in range(1, 5))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int64)
            run = np.empty(len(size), np.int64)
            for s in np.unique(size):
                a, b = np.searchsorted(sizes, [s, s + 1])
                mine = size == s
                run[mine] = a + np.searchsorted(ranks[a:b], rank[mine], "right") - 1
            k = rank - ranks[run]
            sequence, offset = sequences[run] + k // each[run], at[run] + k % each[run] * size
            cols = [batch.column(2), batch.column(3), batch.column(4), pa.array(size), batch.column(5), pa.array(sequence), pa.array(offset)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*cols, *([batch.column(6)] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    return fn


def vector_packed(docs: DataFrame, tokenizer: str, end: int, room: Capacities = Capacities(), with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids as little-endian unsigned 32-bit)."""
    scratch = Scratch(docs.sparkSession, "vector_packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    fields = "part int, size int, rank long, doc_id long, piece int, start long, ids_crc32 long, ids binary"
    pieces = scratch.store(rows.mapInArrow(_cut(tokenizer, end, room.longest, with_ids), fields), "pieces")
    # one row for each worker and length; ranks of a length go on from worker to worker
    counts = pieces.groupBy("part", "size").agg(F.count("*").alias("n"))
    base = counts.select("part", "size", (F.sum("n").over(W.partitionBy("size").orderBy("part")) - F.col("n")).alias("base"), "n")
    base = scratch.store(base, "base")
    # at most one row for each length up to a sequence's tokens
    total = {r["size"]: r["n"] for r in base.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(base.drop("n"), ["part", "size"]).select("size", (F.col("base") + F.col("rank")).alias("rank"), "doc_id", "piece", "start", "ids_crc32", *(["ids"] if with_ids else []))
    return ranked.mapInArrow(_placed(fewest(total, room), with_ids), _PLACED + (", ids binary" if with_ids else ""))


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json", 2)
