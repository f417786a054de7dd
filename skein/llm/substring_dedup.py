"""Substring dedup by fixed-block anchors (operator 9).

A word goes if it lies in a window of `window` consecutive words whose word sequence also starts in
a document with a smaller id. Steps:

1. Index: every document's non-overlapping blocks of (window + 1) // 2 words. Any window of the
   reference document holds one whole block, so a repeated window cannot miss the index.
2. Probe: every rolling window of the block's length, of every document. An anchor is a block that
   another document holds too; hashes travel as 5 bytes and come back as one bit.
3. Extend: around anchors only, every full window is compared by its 64-bit hash with those of all
   documents; runs of windows that a smaller document holds form the maximal exact repeats.

Defined cases: a null or empty text has no words; white space is 0x20 and 0x09-0x0D; a null id is
neither a reference nor cut; rows with one id count as one document, so they do not cut each other;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import texts
from skein.llm.blocks import Block, each_block, exchanged, narrow, packed, slices, unmasked, widen, with_answers
from skein.session import Scratch

SENT = "shard long, block long, hashes binary, extra binary"
RESULT = "doc_id long, tag long, n_words long, n_removed long, spans array<struct<first:int,after:int>>, kept string"


def _doc_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _anchor_hashes(b: Block, h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rolling hashes, usable, aligned) of windows of k words."""
    roll = texts.windows(h, k)
    doc = _doc_of(first)[: len(roll)]
    usable = texts.inside(first, k) & b.known[doc]
    aligned = usable & ((np.arange(len(roll)) - first[doc]) % k == 0)
    return roll, usable, aligned


def _distinct_anchors(b: Block, roll: np.ndarray, usable: np.ndarray, aligned: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a block with flags: 1 an index block has it, 2 two documents have it."""
    at = np.flatnonzero(usable)
    v, ids = roll[at], b.ids[_doc_of(first)[at]]
    order = np.argsort(v, kind="stable")  # ids ascend within a block, and so within equal hashes
    v, ids, ref = v[order], ids[order], aligned[at][order]
    if not len(v):
        return v, np.zeros(0, np.uint8)
    begin = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    end = np.r_[begin[1:], len(v)] - 1
    flags = np.maximum.reduceat(ref.astype(np.uint8), begin) | (2 * (ids[begin] != ids[end])).astype(np.uint8)
    return v[begin], flags


def _live(rows: list[dict]) -> list[bytes]:
    """An anchor is live if an index has it and documents of two blocks, or two of one, hold it."""
    h = np.concatenate([widen(r["hashes"]) for r in rows])
    flags = np.concatenate([np.frombuffer(r["extra"], np.uint8) for r in rows])
    order = np.argsort(h, kind="stable")
    s = h[order]
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[begin, len(s)])
    any_flag = np.bitwise_or.reduceat(flags[order], begin)
    good = ((any_flag & 1) > 0) & ((size > 1) | ((any_flag & 2) > 0))
    out = np.empty(len(h), bool)
    out[order] = np.repeat(good, size)
    cuts = np.cumsum([0, *(len(r["extra"]) for r in rows)])
    return [np.packbits(out[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _earlier(rows: list[dict]) -> list[bytes]:
    """For each window of a block: whether another block has it in a document with a smaller id."""
    h = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in rows])
    ids = np.concatenate([np.frombuffer(r["extra"], "<i8") for r in rows])
    order = np.argsort(h, kind="stable")
    s = h[order]
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    least = np.minimum.reduceat(ids[order], begin)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(least, np.diff(np.r_[begin, len(s)])) < ids[order]
    cuts = np.cumsum([0, *(len(r["extra"]) // 8 for r in rows)])
    return [np.packbits(out[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


class _Windows:
    """The windows of a block that stand near live anchors, with the least id of each."""

    def __init__(self, b: Block, row: dict, window: int, shards: int):
        self.h, self.first = b.words(False)
        k = (window + 1) // 2
        roll, usable, aligned = _anchor_hashes(b, self.h, self.first, k)
        v, _ = _distinct_anchors(b, roll, usable, aligned, self.first)
        live = v[unmasked(list(slices(v, shards)), row["live"], len(v))]
        hit = usable & np.isin(roll, live)
        n = max(0, len(self.h) - window + 1)
        total = np.concatenate([[0], np.cumsum(hit)])
        reach = window - k + 1
        near = total[np.minimum(np.arange(n) + reach, len(hit))] > total[:n]
        doc = _doc_of(self.first)[:n]
        self.at = np.flatnonzero(near & texts.inside(self.first, window) & b.known[doc]) if n else np.zeros(0, int)
        self.v = texts.windows(self.h, window)[self.at] if n else np.zeros(0, np.uint64)
        self.ids = b.ids[doc[self.at]] if n else np.zeros(0, np.int64)
        self.distinct, self.index = np.unique(self.v, return_inverse=True)
        self.least = np.full(len(self.distinct), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.index, self.ids)


def repeated_spans(docs: DataFrame, window: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, tag (xxhash64 of the text), n_words, n_removed, spans (word ranges that go),
    kept (the other words, joined by one space)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    blocks, n = packed(docs, scratch, block_bytes)
    k = (window + 1) // 2

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in each_block(batches):
            h, first = b.words(False)
            roll, usable, aligned = _anchor_hashes(b, h, first, k)
            v, flags = _distinct_anchors(b, roll, usable, aligned, first)
            yield _rows((s, b.number, narrow(v[i:j]), flags[i:j].tobytes()) for s, i, j in slices(v, n))

    live = exchanged(blocks.mapInArrow(send_anchors, SENT), _live, scratch, "live")
    near = with_answers(blocks, live, "live")

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row in each_block(batches):
            w = _Windows(b, row, window, n)
            yield _rows((s, b.number, w.distinct[i:j].astype("<u8").tobytes(), w.least[i:j].astype("<i8").tobytes()) for s, i, j in slices(w.distinct, n))

    earlier = exchanged(near.mapInArrow(send_windows, SENT), _earlier, scratch, "earlier")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row in each_block(batches):
            w = _Windows(b, row, window, n)
            other = unmasked(list(slices(w.distinct, n)), row["earlier"], len(w.distinct))
            covered = (w.ids > w.least[w.index]) | other[w.index]
            gone = np.zeros(len(w.h) + 1, np.int64)
            np.add.at(gone, w.at[covered], 1)
            np.add.at(gone, w.at[covered] + window, -1)
            yield from _results(b, w.first, np.cumsum(gone)[:-1] > 0)

    return with_answers(near, earlier, "earlier").mapInArrow(cut, RESULT)


def _rows(items) -> pa.RecordBatch:
    cols = list(zip(*items, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "hashes", "extra"])


def _results(b: Block, first: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts, ends, _ = texts.word_bounds(b.body, b.offsets)
    for lo, hi in texts.pieces(len(b.ids), b.offsets, 1 << 20):
        w0, w1 = first[lo], first[hi]
        f = first[lo : hi + 1] - w0
        cut = gone[w0:w1]
        body, off = joined(b.body, starts[w0:w1], ends[w0:w1], ~cut, f)
        edge = np.diff(np.concatenate([[0], cut.astype(np.int8), [0]]))
        inner = f[1:-1][(f[1:-1] > 0) & (f[1:-1] < len(cut))]
        both = np.unique(inner[cut[inner - 1] & cut[inner]]) if len(inner) else inner
        begin, after = np.sort(np.r_[np.flatnonzero(edge == 1), both]), np.sort(np.r_[np.flatnonzero(edge == -1), both])
        doc = np.searchsorted(f, begin, "right") - 1
        span_off = np.searchsorted(begin, f, "left").astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(span_off), pa.StructArray.from_arrays([pa.array((begin - f[doc]).astype(np.int32)), pa.array((after - f[doc]).astype(np.int32))], ["first", "after"]))
        total = np.concatenate([[0], np.cumsum(cut)])
        ids = pa.array(b.ids[lo:hi], pa.int64(), mask=~b.known[lo:hi])
        kept = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(body))
        yield pa.RecordBatch.from_arrays([ids, pa.array(b.tags[lo:hi]), pa.array(np.diff(f)), pa.array(total[f[1:]] - total[f[:-1]]), spans, kept], ["doc_id", "tag", "n_words", "n_removed", "spans", "kept"])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes, offsets by document) of the kept words joined by one space."""
    at = np.flatnonzero(keep)
    length = ends[at] - starts[at] + 1
    to = np.concatenate([[0], np.cumsum(length)])
    if not len(at):
        return b"", np.zeros(len(first), np.int64)
    index = np.arange(to[-1]) + np.repeat(starts[at] - to[:-1], length)
    out = data[np.minimum(index, len(data) - 1)]
    out[to[1:] - 1] = 0x20
    kept_before = np.searchsorted(at, first)
    drop = np.zeros(len(out), bool)
    last = kept_before[1:][kept_before[1:] > kept_before[:-1]]
    drop[to[last] - 1] = True  # the space after a document's last word
    off = to[kept_before] - np.concatenate([[0], np.cumsum(drop)])[to[kept_before]]
    return out[~drop].tobytes(), off


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 starts AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13),
 win AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS t FROM starts),
 least AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
 hit AS (SELECT r, i FROM win JOIN least USING (t) WHERE m < doc_id),
 gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM hit),
 lists AS (SELECT r, list(j) AS js FROM gone GROUP BY r),
 kept AS (SELECT doc_id, w, coalesce(len(js), 0) AS n, CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END AS k FROM d LEFT JOIN lists USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
