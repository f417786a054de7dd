"""N-gram Jaccard join (operator 7): prefix filtering over rare-first ordered shingles.

Every document is the set of its distinct k-word shingles; two documents link when
100 * |A and B| >= percent * |A or B|.

* Copies: documents with one and the same set stand for each other; one of them goes on.
* Rare first: shingles are ordered by (number of sets that have it, hash). The numbers are counted over all
  sets in an exchange of packed arrays, exactly up to 64 and by their logarithm beyond.
* Prefix filter: two linked documents share a shingle among their first n - ceil(n * t) + 1, and for the
  smaller of the two already among its first n - ceil(2 * t * n / (1 + t)) + 1. Only shingles of a prefix
  that several sets have go on.
* Length and positional filters act on each meeting in a shingle, and on each pair with all its
  meetings; the suffix filter acts on both sets, before they are intersected. A pair is verified once.
* Large groups of near copies: where more than `few` sets meet in a shingle, each is compared with one
  pivot. Two that both link to it need no comparison to be in one component. All others are found by a
  second prefix filter, over the shingles in which a set differs from the pivot; where more than `few` meet
  again, they get a pivot of their own, and so on for up to LEVELS levels. Pairs verified grow with such a group and with
  the links it has, not with its square (tested with families near to and far from their pivot). No link between components is lost.
* All links: jaccard_links and link_counts take no such shortcut and verify every pair of different sets
  that passes the filters.

Defined cases: words are runs of other bytes than 0x20, 0x09-0x0D, with A-Z lowered; fewer than k words
make one shingle; a null, empty or blank text has none and links with nothing; a null id links with
nothing and gets a null component; rows with one id count as one document; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from skein.llm import texts
from skein.llm.blocks import exchanged, narrow, slices, widen, with_answers
from skein.operators.components import connected_components
from skein.session import Scratch, settings

_PIECE = 4 << 20
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_BLOCK_FIELDS = ["block", "ids", "known", "sizes", "digests", "offsets", "body"]
_MEETING = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("before", pa.int64()), ("short", pa.bool_()), ("shingles", pa.binary())])
#: Bytes of each hash that sets are compared by: two different shingles of two sets of n meet with a probability of n * n / 2**48.
_WIDTH = 6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's distinct shingles, ascending."""
    h, first = texts.words(data, offsets, True)
    size = np.diff(first)
    doc_of = np.repeat(np.arange(len(size)), size)
    roll = texts.windows(h, k)
    ok = texts.inside(first, k)
    v, d = [roll[ok]], [doc_of[: len(roll)][ok]]
    for m in range(1, k):
        short = np.flatnonzero(size == m)
        if len(short):
            v.append(texts.windows(h, m)[first[short]])
            d.append(short)
    v, d = np.concatenate(v), np.concatenate(d)
    order = np.lexsort((v, d))
    v, d = v[order], d[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (d[1:] != d[:-1])] if len(v) else np.zeros(0, bool)
    v, d = v[new], d[new]
    return v, np.searchsorted(d, np.arange(len(size) + 1))


def _digests(v: np.ndarray, off: np.ndarray) -> bytes:
    """128 bits of each set, from its ascending hashes."""
    import hashlib

    raw = v.astype("<u8").tobytes()
    return b"".join(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))


def _blocks(docs: DataFrame, k: int) -> DataFrame:
    """Documents in blocks of a few MB, with each one's number of shingles and the digest of its set. A row's number is
    the block's and its place in it; tables below are made of stored blocks, so it stays the same when a task runs again."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = texts.buffers(batch.column(1))
            for lo, hi in texts.pieces(batch.num_rows, offsets, _PIECE):
                body, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ids = batch.column(0).slice(lo, hi - lo)
                v, at = shingle_sets(body, off, k)
                cells = (np.asarray(ids.fill_null(0)).astype("<i8"), np.asarray(ids.is_valid()).astype(np.uint8), np.diff(at).astype("<i8"), _digests(v, at), off.astype("<i8"), body)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in cells)], _BLOCK_FIELDS)
                number += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(fn, "block long, ids binary, known binary, sizes binary, digests binary, offsets binary, body binary")


def _signatures(blocks: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n, digest (null for an empty set), row, block."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, n = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
                m, empty, raw = len(ids), n == 0, row["digests"]
                digests = pa.array([raw[i : i + 16] for i in range(0, 16 * m, 16)], pa.binary(), mask=empty)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=np.frombuffer(row["known"], np.uint8) == 0), pa.array(n), digests, pa.array(row["block"] + np.arange(m)), pa.array([row["block"]] * m, pa.int64())], ["doc_id", "n", "digest", "row", "block"])

    return blocks.select("block", "ids", "known", "sizes", "digests").mapInArrow(fn, "doc_id long, n long, digest binary, row long, block long")


def _different(row: dict) -> np.ndarray:
    """Places in a block of the first document of each different set."""
    ok = np.flatnonzero((np.frombuffer(row["known"], np.uint8) > 0) & (np.frombuffer(row["sizes"], "<i8") > 0))
    digests = np.frombuffer(row["digests"], "V16")[ok]
    return np.array(sorted(dict(zip(digests.tolist()[::-1], ok.tolist()[::-1], strict=True)).values()), np.int64)


def _sets_at(row: dict, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the documents at the given places of a block."""
    off, body = np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["body"], np.uint8)
    if len(at) < len(off) - 1:
        body = np.concatenate([body[:0], *(body[off[i] : off[i + 1]] for i in at)])
        off = np.concatenate([[0], np.cumsum(off[at + 1] - off[at])])
    return shingle_sets(body, off, k)


def _frequencies(rows: list[dict]) -> list[bytes]:
    """For each shingle of a block: a byte that grows with the number of sets that have it, 1 for one set. A set counts
    once in each block that has it, so copies may raise the number, by the same for all who see the shingle."""
    h = np.concatenate([widen(r["hashes"]) for r in rows])
    count = np.concatenate([np.frombuffer(r["extra"], np.uint8) for r in rows])
    order = np.argsort(h, kind="stable")
    s = h[order]
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    total = np.add.reduceat(count[order], begin, dtype=np.int64)
    code = np.where(total <= 64, total, 64 + np.minimum(191, 8 * np.log2(total / 64))).astype(np.uint8)
    out = np.empty(len(h), np.uint8)
    out[order] = np.repeat(code, np.diff(np.r_[begin, len(s)]))
    cuts = np.cumsum([0, *(len(r["extra"]) for r in rows)])
    return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _meetings(blocks: DataFrame, nodes: DataFrame, k: int, percent: int, shards: int, scratch: Scratch) -> DataFrame:
    """Two kinds of rows. For each prefix shingle that several sets have: h, doc (the set's number), id, n, pos, before
    (those before it that several sets have) and short (whether a set of its size or more can first meet it here). For
    each set with such a row: doc and its shingles."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v, count = np.unique(_sets_at(row, _different(row), k)[0], return_counts=True)
                count = np.minimum(count, 255).astype(np.uint8)
                got = [(s, row["block"], narrow(v[a:b]), count[a:b].tobytes()) for s, a, b in slices(v, shards)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "hashes", "extra"])

    answers = exchanged(blocks.mapInArrow(send, "shard long, block long, hashes binary, extra binary"), _frequencies, scratch, "frequencies")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places, digests, first = _different(row), np.frombuffer(row["digests"], "V16").tolist(), row["block"]
                standing = {digests[x - first]: x for x in row["nodes"] or ()}
                nodes = np.array([standing.get(digests[i], -1) for i in places], np.int64)
                ids = np.frombuffer(row["ids"], "<i8")[np.maximum(nodes - first, 0)]
                h, off = _sets_at(row, places, k)
                v, at = np.unique(h, return_inverse=True)
                by_shard = {a["shard"]: a["mask"] for a in row["answers"] or ()}
                freq = np.frombuffer(b"".join(by_shard[s] for s, _, _ in slices(v, shards)), np.uint8)[at]
                n = np.diff(off)
                d = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, freq, d))
                ranked, shared = h[order], freq[order] > 1
                pos = np.arange(len(h)) - off[d]
                before = np.concatenate([[0], np.cumsum(shared)])
                reach = n - -(-percent * n // 100) + 1
                short = n - -(-2 * percent * n // (100 + percent)) + 1
                keep = np.flatnonzero(shared & (pos < reach[d]) & (nodes >= 0)[d])
                at, d = pos[keep], d[keep]
                columns = [ranked[keep].view(np.int64), nodes[d], ids[d], n[d], at, before[keep] - before[off[d]], at < short[d]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(keep), pa.binary())], schema=_MEETING)
                d = np.unique(d)
                own = {"doc": pa.array(nodes[d]), "shingles": pa.array([_packed_set(h[off[i] : off[i + 1]]) for i in d], pa.binary())}
                yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(d), f.type)) for f in _MEETING], schema=_MEETING)

    both = with_answers(blocks, answers, "answers").join(nodes, "block").mapInArrow(meet, "h long, doc long, id long, n long, pos long, before long, short boolean, shingles binary")
    return scratch.store(both, "met")


def _packed_set(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH]).tobytes()


def _set(cell: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(cell.as_buffer(), np.uint8).reshape(-1, _WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_WIDTH] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """No fewer than |A and B| for ascending arrays: both are split at the middle of one, and parts meet parts only."""
    if not len(a) or not len(b) or not depth:
        return min(len(a), len(b))
    m = len(a) // 2
    j = int(np.searchsorted(b, a[m]))
    same = j < len(b) and b[j] == a[m]
    return suffix_bound(a[:m], b[:j], depth - 1) + same + suffix_bound(a[m + 1 :], b[j + same :], depth - 1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b)
    need = -(-percent * both // (100 + percent))
    if suffix_bound(a, b, 2) < need:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (both - shared)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x, y = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([similar(_set(x), _set(y), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return _with_sets(pairs, sets).mapInArrow(fn, "a long, b long")


def _edited(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b = pivot) with both sizes, whether they link, and the shingles that only one of the two has."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _set(x), _set(y)
                edits = np.setxor1d(x, y, assume_unique=True)
                out.append((len(x), len(y), (100 + percent) * len(edits) <= (100 - percent) * (len(x) + len(y)), edits.astype("<u8").tobytes()))
            n, m, ok, raw = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(ok, pa.bool_()), pa.array(raw, pa.binary())], ["a", "b", "n", "m", "linked", "edits"])

    return _with_sets(pairs, sets).mapInArrow(fn, "a long, b long, n long, m long, linked boolean, edits binary")


def _edits(edited: DataFrame) -> DataFrame:
    """Rows (p, doc, n, m, d, linked, e) of a document's edits e, of which it has d."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(5)]
            d = np.array([len(x) for x in raw], np.int64)
            a, b, n, m, linked = (np.repeat(np.asarray(batch.column(i).to_numpy(zero_copy_only=False)), d) for i in range(5))
            e = np.concatenate([*raw, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b, a, n, m, np.repeat(d, d), linked.astype(bool), e)], ["p", "doc", "n", "m", "d", "linked", "e"])

    return edited.mapInArrow(fn, "p long, doc long, n long, m long, d long, linked boolean, e long")


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")


def _pair() -> tuple[Column, Column]:
    return F.least("doc1", "doc2").alias("a"), F.greatest("doc1", "doc2").alias("b")


def _side(rows: DataFrame, key: list[str], fields: tuple[str, ...], i: int) -> DataFrame:
    return rows.select(*key, *(F.col(c).alias(f"{c}{i}") for c in fields))


def _met_pairs(meet: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that meet and can reach the threshold.

    The smaller set of a pair has to meet the other in a shorter prefix than the larger one (both orders by size break
    ties alike). On each meeting act the length and the positional filter: before it, the two have at most what
    several sets have. On each pair with all its meetings: behind the last one no more can follow than the shorter rest."""
    fields = ("doc", "n", "pos", "before")
    first = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("doc1") < F.col("doc2")))
    rest = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    both = F.col("n1") + F.col("n2")
    met = _side(meet.where("short"), ["h"], fields, 1).join(_side(meet, ["h"], fields, 2), "h")
    met = met.where(first & _sizes_fit(percent) & ((100 + percent) * (F.least("before1", "before2") + rest) >= percent * both))
    pair = met.groupBy("doc1", "doc2", "n1", "n2").agg(F.count("*").alias("c"), F.max("pos1").alias("pos1"), F.max("pos2").alias("pos2"))
    return pair.where((100 + percent) * (F.col("c") + rest - 1) >= percent * both).select(*_pair())


def _edit_rows(edits: DataFrame, percent: int) -> DataFrame:
    """Where the sets around one pivot p meet that can link to each other, unless both link to p: rows (key, doc, n, d, s,
    before, far, low).

    With d edits each, two sets differ in d1 + d2 - 2 * (edits in common) shingles, and they link where that is at most
    c * (n1 + n2), c = (100 - percent) / (100 + percent). So d1 and d2 are no further apart than that, and the
    two need (d1 + d2 - c * (n1 + n2)) / 2 edits in common. Numbers of edits fall into buckets; for each bucket that
    a partner may be in, a set has a prefix of its edits, rarest first, whose length follows from what the two need. They
    meet in an edit of both prefixes, under both buckets; `low` tells whose is the lower one. Edits that only one set has
    are counted, not joined."""
    up, down = 100 + percent, 100 - percent
    times = edits.groupBy("p", "e").agg(F.count("*").alias("times")).where("times > 1")
    ranked = W.partitionBy("p", "doc")
    shared = edits.join(times, ["p", "e"]).select("*", (F.row_number().over(ranked.orderBy("times", "e")) - 1).alias("before"), F.count("*").over(ranked).alias("s"))
    width = F.greatest(F.lit(1), F.expr(f"{down} * m div {2 * up}"))
    most = F.expr(f"n * 100 div {percent}")  # the largest and smallest partner: n * 100 / percent and n * percent / 100
    reach = F.expr(f"{down} * (n + n * 100 div {percent}) div {up}")  # no partner's number of edits is further away
    beyond = F.expr(f"{down} * ((n * {percent} + 99) div 100 + m) div {up}")  # a partner that does not link to the pivot has more
    first = F.greatest(F.lit(0).cast("long"), F.col("d") - reach, F.when(F.col("linked"), beyond).otherwise(0))
    shared = shared.withColumns({"w": width}).withColumns({"j1": F.floor(first / F.col("w")), "j2": F.floor((F.col("d") + reach) / F.col("w"))})
    shared = shared.where("j1 <= j2").withColumn("j", F.explode(F.sequence("j1", "j2")))
    need = F.greatest(F.lit(1), F.ceil((up * (F.col("d") + F.col("j") * F.col("w")) - down * (F.col("n") + most)) / F.lit(2 * up)))
    b = F.floor(F.col("d") / F.col("w"))
    rows = shared.where(F.col("before") <= F.col("s") - need).withColumn("b", b)
    low, high = F.least("b", "j"), F.greatest("b", "j")
    return rows.select(F.struct("p", "e", low.alias("lo"), high.alias("hi")).alias("key"), "doc", "n", "d", "s", "before", (~F.col("linked")).alias("far"), (F.col("b") == low).alias("low"))


def _keys(rows: DataFrame) -> DataFrame:
    """(key, sets, p2) of the keys in which a pair can meet: their number of sets, and the first that does not link to the pivot."""
    keys = rows.groupBy("key").agg(F.count("*").alias("sets"), F.min(F.when(F.col("far"), F.col("doc"))).alias("p2"), F.max("low").alias("lows"), F.min("low").alias("all_low"))
    both = (F.col("key.lo") == F.col("key.hi")) | (F.col("lows") & ~F.col("all_low"))
    return keys.where((F.col("sets") > 1) & F.col("p2").isNotNull() & both).select("key", "sets", "p2")


def _key_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows of each key, one of them at least far from the pivot, that can have the edits in common they need."""
    up, down = 100 + percent, 100 - percent
    fields = ("doc", "n", "d", "s", "before", "far", "low")
    most = F.least("before1", "before2") + F.least(F.col("s1") - F.col("before1"), F.col("s2") - F.col("before2"))
    met = _side(rows.where("low"), ["key"], fields, 1).join(_side(rows, ["key"], fields, 2), "key")
    once = F.when(F.col("key.lo") == F.col("key.hi"), F.col("doc1") < F.col("doc2")).otherwise(~F.col("low2"))
    met = met.where(once & (F.col("far1") | F.col("far2")) & _sizes_fit(percent) & (2 * up * most >= up * (F.col("d1") + F.col("d2")) - down * (F.col("n1") + F.col("n2"))))
    return met.select(*_pair()).distinct()


#: Levels of pivots after which the pairs of a key that is still crowded are formed.
LEVELS = 8


def _links(meet: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, few: int, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) enough to make all components: every two sets that meet and can link are verified, or both link to
    one pivot. Keys, shingles at first, with up to `few` sets give pairs; in the others each set is compared with the
    key's pivot (of a shingle the one with the smallest id, as an original comes before its copies). What lies
    beyond it meets again by its edits, under new keys, and so on: a family of copies that is far from one pivot has a pivot of
    its own at the next level."""
    if meet.isEmpty():
        return meet.sparkSession.createDataFrame([], "a long, b long")
    known = scratch.store(_met_pairs(meet.where(F.col("sets") <= few), percent), "pairs")
    links = scratch.store(_verified(known, sets, percent), "links")
    crowd = meet.where(F.col("sets") > few)
    pivot = crowd.groupBy("h").agg(F.min(F.struct("id", "doc")).alias("p")).select("h", F.col("p.doc").alias("b"))
    around = crowd.select("h", F.col("doc").alias("a")).join(pivot, "h").select("a", "b")
    for level in range(levels):
        around = scratch.store(around.where("a <> b").select("a", "b").distinct(), f"around{level}")
        if around.isEmpty():
            break
        edited = scratch.store(_edited(around, sets, percent), f"edited{level}")
        links = links.union(edited.where("linked").select("a", "b"))
        rows = scratch.store(_edit_rows(_edits(edited), percent), f"edits{level}")
        keys = scratch.store(_keys(rows), f"keys{level}")
        known = known.union(around.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        last = level == levels - 1
        small = keys if last else keys.where(F.col("sets") <= few)
        pairs = scratch.store(_key_pairs(rows.join(small.select("key"), "key"), percent).join(known, ["a", "b"], "left_anti"), f"pairs{level}")
        known = known.union(pairs)
        links = links.union(scratch.store(_verified(pairs, sets, percent), f"links{level}"))
        if last:
            break
        around = rows.join(keys.where(F.col("sets") > few), "key").select(F.col("doc").alias("a"), F.col("p2").alias("b"))
    return links


def _prepared(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows of docs (doc_id, n, digest), classes (digest, first, node), meetings with their number of sets, sets).
    A node is the number of the row that stands for all rows with its set, first their smallest id."""
    blocks = scratch.store(_blocks(docs, k), "blocks")
    rows = scratch.store(_signatures(blocks), "signatures")
    named = rows.where("doc_id is not null and digest is not null")
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "block")).alias("x")).select("digest", F.col("x.doc_id").alias("first"), F.col("x.row").alias("node"), F.col("x.block").alias("block"))
    classes = scratch.store(classes, "classes")
    total = named.agg(F.sum("n")).first()[0]
    nodes = classes.groupBy("block").agg(F.collect_list("node").alias("nodes"))
    met = _meetings(blocks, nodes, k, percent, texts.blocks_for(total, 2 << 20), scratch)
    scratch.drop("blocks", "frequencies")
    meet = met.where("h is not null").drop("shingles")
    several = meet.groupBy("h").agg(F.count("*").alias("sets"), F.max("short").alias("some")).where("sets > 1 and some").drop("some")
    meet = scratch.store(meet.join(several, "h"), "meet")
    return rows.select("doc_id", "n", "digest"), classes.drop("block"), meet, met.where("h is null").select("doc", "shingles")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, few: int = 64) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    with settings(docs.sparkSession, _BATCHES):
        rows, classes, meet, sets = _prepared(docs, k, percent, scratch)
        links = _links(meet, sets, percent, scratch, few)
    return _with_components(rows, classes, links, scratch)


def _with_components(rows: DataFrame, classes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    # rows of one id are one document: their sets are joined
    own = rows.where("doc_id is not null and digest is not null").join(classes, "digest").select("doc_id", "node")
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    same = own.join(several, "doc_id").select("a", F.col("node").alias("b"))
    comp = scratch.store(connected_components(links.union(same)).select(F.col("id").alias("node"), "component"), "components")
    scratch.drop("met", "meet", "pairs", "links", *(f"{x}{i}" for x in ("around", "edited", "edits", "keys", "pairs", "links") for i in range(LEVELS)))
    least = classes.join(comp, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    found = classes.join(comp.join(least, "component").select("node", "component_id"), "node", "left").select("digest", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(found, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _set_links(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, classes, members (doc_id, set), links (a, b) of different sets): every pair that meets and passes the filters is verified."""
    with settings(docs.sparkSession, _BATCHES):
        rows, classes, meet, sets = _prepared(docs, k, percent, scratch)
        pairs = scratch.store(_met_pairs(meet, percent), "all_pairs")
        links = scratch.store(_verified(pairs, sets, percent), "all_links")
    members = rows.where("doc_id is not null and digest is not null").join(classes, "digest").select("doc_id", F.col("node").alias("set")).distinct()
    members = scratch.store(members, "members")
    scratch.drop("met", "meet", "all_pairs")
    return rows, classes, members, links


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(a, b) with a < b: every two ids that link, those of copies included. A group of n copies has n * (n - 1) / 2 of them."""
    _, _, members, links = _set_links(docs, k, percent, Scratch(docs.sparkSession, "links"))
    near = links.union(links.select("b", "a")).union(members.select("set", "set").toDF("a", "b").distinct())
    x, y = members.toDF("x", "a"), members.toDF("y", "b")
    return near.join(x, "a").join(y, "b").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def link_counts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, n_links (how many other ids it links with). Copies are counted by
    class, not paired."""
    scratch = Scratch(docs.sparkSession, "link_counts")
    rows, classes, members, links = _set_links(docs, k, percent, scratch)
    several = members.groupBy("doc_id").agg(F.count("*").alias("sets"))
    members = scratch.store(members.join(several, "doc_id").select("doc_id", "set", (F.col("sets") > 1).alias("several")), "nodes")
    # ids of one set are one node by set; an id of several is a node of its own
    members = members.withColumn("node", F.when(F.col("several"), F.col("doc_id")).otherwise(F.col("set")))
    near = links.union(links.select("b", "a")).union(members.select("set", "set").distinct()).toDF("set", "other")
    reach = members.select("several", "node", "set").distinct().join(near, "set").select("several", "node", "other").distinct()
    single = members.where("not several").groupBy(F.col("set").alias("other")).agg(F.count("*").alias("n"))
    multiple = members.where("several").select(F.col("set").alias("other"), F.col("doc_id").alias("id"))
    counted = reach.join(single, "other").groupBy("several", "node").agg(F.sum("n").alias("n"))
    more = reach.join(multiple, "other").groupBy("several", "node").agg(F.countDistinct("id").alias("n"))
    total = counted.union(more).groupBy("several", "node").agg((F.sum("n") - 1).alias("n_links"))  # a node reaches itself
    found = members.select("doc_id", "several", "node").distinct().join(total, ["several", "node"]).select("doc_id", "n_links")
    grouped = _with_components(rows, classes, links, scratch)
    return grouped.join(found, "doc_id", "left").select("doc_id", "n_shingles", "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


def op7_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
 e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = w.doc_id
"""

OP7_LINKS_SQL = OP7_SQL.replace("m.component_id\nFROM w", "m.component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links\nFROM w LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = w.doc_id")
