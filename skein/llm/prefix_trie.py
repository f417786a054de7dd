"""Conversation prefix trie (operator 13), by mergeable partial tries.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it.
Its key is a polynomial in two 64-bit lanes over the digests of the turns, so the key of a sequence put
together from two parts follows from the keys of the parts.

* Keys: turns are sorted by range over (conversation, turn), and each task emits fragments, packed arrays of
  running keys. A conversation of any length is spread over tasks and fragments; what lies before a
  fragment comes from running sums over one row a fragment.
* Partial tries: each task emits a table of its nodes, combined locally, with each one's smallest member and
  number of members. Tables are merged by key in rounds, some hundreds at a time, until one is left.
* Paths: with its smallest member m and its depth a node has a name of its own, and the nodes of one m are a
  path down to the end of m. So parents, children and sums need keys only at the top of a path.
* Rollup: sums over subtrees go bottom-up over the tree of paths, doubling the distance in each round, and
  then along each path from its end, in segments of bounded length. A node with very many children is
  only ever summed, a path of any length is split.
* Ends: the members that end at a node are sorted by range, joined into chunks, and the chunks of a node are
  hashed in order, one at a time.

Defined cases: turns are ordered by turn (nulls first), then by the digest of role and text; repeated
rows are turns of their own; a null role or text is empty; rows with a null conv_id belong to no conversation
and take no part; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from skein.llm import texts
from skein.session import Scratch

#: Bases of the two lanes, odd.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOW = (1 << 64) - 1
#: Bytes of text for each sorted partition, and the most partitions there are; larger ones spill.
_EACH, _MOST = 16 << 20, 20_000
#: Nodes of a path that are summed together.
SEGMENT = 4096
#: Rows that a task gathers before it combines them.
_GATHERED = 1 << 17

_FRAGMENT = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("end1", pa.int64()), ("end2", pa.int64()), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64()))])
_FRAGMENTS = "conv_id long, seq long, n long, end1 long, end2 long, k1 array<long>, k2 array<long>, chars array<long>"
_NODE = pa.schema([("slot", pa.int64()), ("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("chars", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.bool_())])
_NODES = "slot long, depth long, k1 long, k2 long, p1 long, p2 long, chars long, conv_id long, n long, ends boolean"


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of a turn; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def _fragments(conversations: DataFrame) -> DataFrame:
    """Packed keys of the turns: a conversation's fragments are in its order by seq, their keys start anew."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = np.asarray(batch.column(0))
            turn = np.frombuffer(texts.buffers(batch.column(1))[0], "<u8").reshape(n, 2)
            first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            stop = np.r_[first[1:], n]
            start = np.repeat(first, stop - first)
            lanes = []
            with np.errstate(over="ignore"):
                for lane, base in enumerate(BASES):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turn[:, lane] * _powers(base, n))])
                    lanes.append((total[1:] - total[start]) * _powers(pow(base, -1, 1 << 64), n)[start])
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[first, n].astype(np.int32)), pa.array(x.view(np.int64))) for x in lanes]
            chars = pa.ListArray.from_arrays(pa.array(np.r_[first, n].astype(np.int32)), batch.column(2).cast(pa.int64()))
            ends = [pa.array(x[stop - 1].view(np.int64)) for x in lanes]
            yield pa.RecordBatch.from_arrays([pa.array(conv[first]), pa.array(seq + np.arange(len(first))), pa.array(stop - first), *ends, *lists, chars], schema=_FRAGMENT)
            seq += len(first)

    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(F.col("role"), F.col("text")).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    size = conversations.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0]
    count = min(_MOST, max(texts.blocks_for(size, _EACH), conversations.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartitionByRange(count, "conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    return dealt.select("conv_id", "digest", "chars").mapInArrow(fn, _FRAGMENTS)


def _placed(fragments: DataFrame) -> DataFrame:
    """Fragments with the number of turns before them (`before`) and the key of those (b1, b2)."""
    several = fragments.groupBy("conv_id").agg(F.count("*").alias("pieces")).where("pieces > 1").select("conv_id")
    order = W.partitionBy("conv_id").orderBy("seq")
    parts = fragments.select("conv_id", "seq", "n", "end1", "end2").join(several, "conv_id", "left_semi")
    parts = parts.withColumn("before", F.sum("n").over(order) - F.col("n"))

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # keys at their place, in halves whose sums stay far below 2**63
        for batch in batches:
            cols = [batch.column(0), batch.column(1), batch.column(2)]
            for lane, base in enumerate(BASES):
                with np.errstate(over="ignore"):
                    x = np.asarray(batch.column(3 + lane)).view(np.uint64) * np.array([_power(base, b) for b in batch.column(2).to_pylist()], np.uint64)
                cols += [pa.array((x & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array((x >> np.uint64(32)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "seq", "before", "l1", "u1", "l2", "u2"])

    halves = parts.select("conv_id", "seq", "before", "end1", "end2").mapInArrow(shifted, "conv_id long, seq long, before long, l1 long, u1 long, l2 long, u2 long")
    sums = halves.select("conv_id", "seq", "before", *((F.sum(c).over(order) - F.col(c)).alias(c) for c in ("l1", "u1", "l2", "u2")))
    whole = [F.coalesce(_wrapped(F.col(f"u{i}"), F.col(f"l{i}")), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)]
    return fragments.join(sums, ["conv_id", "seq"], "left").select(*fragments.columns, F.coalesce("before", F.lit(0).cast("long")).alias("before"), *whole)


def _wrapped(upper: Column, lower: Column) -> Column:
    """upper * 2**32 + lower modulo 2**64, as a signed long."""
    carried = F.pmod(upper + F.shiftright(lower, 32), F.lit(1 << 32))
    return F.shiftleft(carried, 32).bitwiseOR(lower.bitwiseAND(F.lit((1 << 32) - 1)))


def _heads(placed: DataFrame, most: int) -> DataFrame:
    """(conv_id, head): keys and lengths of the first turns, `most` at most."""
    near = placed.where(F.col("before") < most)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["conv_id"], r["before"] + i, k1, k2, c) for r in _whole(batch) for i, (k1, k2, c) in enumerate(zip(r["k1"][:most].tolist(), r["k2"][:most].tolist(), r["chars"][:most].tolist(), strict=True)) if r["before"] + i < most]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], ["conv_id", "place", "k1", "k2", "chars"])

    turns = near.mapInArrow(fn, "conv_id long, place long, k1 long, k2 long, chars long")
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "k1", "k2", "chars"))).alias("head"))


def _whole(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of placed fragments with the keys of whole prefixes, as signed arrays."""
    names = batch.schema.names
    scalars = {c: batch.column(names.index(c)).to_pylist() for c in names if c not in ("k1", "k2", "chars")}
    lists = {c: batch.column(names.index(c)) for c in ("k1", "k2", "chars")}
    for i in range(batch.num_rows):
        row = {c: v[i] for c, v in scalars.items()}
        for lane, base in enumerate(BASES, 1):
            x = np.asarray(lists[f"k{lane}"][i].values)
            if row["before"]:
                with np.errstate(over="ignore"):
                    x = (x.view(np.uint64) * _power(base, row["before"]) + np.uint64(row[f"b{lane}"] & _LOW)).view(np.int64)
            row[f"k{lane}"] = x
        yield row | {"chars": np.asarray(lists["chars"][i].values)}


def _partial_tries(placed: DataFrame, starts: DataFrame) -> DataFrame:
    """Each task's table of nodes, and a row with `ends` set for the node where a conversation ends.

    starts: conv_id, length (of the conversation), h, own (its head), base (the head that replaces its first h turns)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, parts, gathered = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            for row in _whole(batch):
                parts += _path(row)
                gathered += len(row["chars"]) + 8
                if gathered >= _GATHERED:
                    yield _combined(parts, slot)
                    parts, gathered = [], 0
        if parts:
            yield _combined(parts, slot)

    return placed.select("conv_id", "before", "b1", "b2", "n", "k1", "k2", "chars").join(starts, "conv_id").mapInArrow(fn, _NODES)


def _path(row: dict) -> Iterator[np.ndarray]:
    """Columns depth, k1, k2, p1, p2, chars, conv_id, ends of the nodes that a fragment adds to the conversation's path."""
    h, own = row["h"], row["own"]
    head = (row["base"] or ())[:h]
    lead = len(head)
    tail = max(row["length"] - h, 0)
    if not row["before"]:  # the root and the head, once for each conversation
        keys = np.array([(0, 0), *((x["k1"], x["k2"]) for x in head)], np.int64)
        out = np.zeros((lead + 1, 8), np.int64)
        out[:, 0], out[:, 1:3], out[1:, 3:5] = np.arange(lead + 1), keys, keys[:-1]
        out[1:, 5], out[:, 6] = [x["chars"] for x in head], row["conv_id"]
        out[lead, 7] = not tail
        yield out
    skip = max(h - row["before"], 0)
    n = row["n"] - skip
    if n <= 0:
        return
    out = np.zeros((n, 8), np.int64)
    out[:, 0] = lead + row["before"] + skip - h + 1 + np.arange(n)
    for lane, base in enumerate(BASES, 1):
        with np.errstate(over="ignore"):
            at = np.uint64((own[h - 1][f"k{lane}"] & _LOW) if h else 0)
            joint = np.uint64((head[-1][f"k{lane}"] & _LOW) if lead else 0)
            key = (row[f"k{lane}"][skip:].view(np.uint64) - at) * _power(base, lead - h) + joint
            if skip or row["before"] <= h:
                before = joint
            else:
                before = (np.uint64(row[f"b{lane}"] & _LOW) - at) * _power(base, lead - h) + joint
        out[:, lane], out[0, lane + 2], out[1:, lane + 2] = key.view(np.int64), before.view(np.int64), key[:-1].view(np.int64)
    out[:, 5], out[:, 6] = row["chars"][skip:], row["conv_id"]
    out[n - 1, 7] = row["before"] + row["n"] == row["length"]
    yield out


def _combined(parts: list[np.ndarray], slot: int) -> pa.RecordBatch:
    """One row a node, with the smallest member and the number of members, and the rows of conversations that end."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 6], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
    ends = np.flatnonzero(rows[:, 7])
    n = np.concatenate([np.diff(np.r_[first, len(rows)]), np.zeros(len(ends), np.int64)])
    pick = np.concatenate([first, ends])
    cols = [np.full(len(pick), slot), *(rows[pick, i] for i in range(7)), n, np.arange(len(pick)) >= len(first)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_NODE)


def _merged(tables: DataFrame, slots: int, fan: int, scratch: Scratch) -> DataFrame:
    """Node tables of all slots into one: `fan` tables are merged at a time, round after round."""
    i = 0
    while True:
        slots = -(-slots // fan)
        key = [F.expr(f"slot div {fan}").alias("slot")] if slots > 1 else [F.lit(0).cast("long").alias("slot")]
        tables = tables.groupBy(*key, "depth", "k1", "k2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
        tables = scratch.store(tables, f"nodes-{i}")
        if slots == 1:
            return tables.drop("slot")
        i += 1


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where conversations end."""
    key = ["depth", "k1", "k2"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(i)) for i in range(4)])
            first = np.flatnonzero(np.r_[True, (x[1:, :3] != x[:-1, :3]).any(axis=1)]) if len(x) else np.zeros(0, np.int64)
            bodies = [",".join(map(str, x[a:b, 3].tolist())) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=False)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first, i]) for i in range(4)), pa.array(bodies, pa.string())], [*key, "first", "body"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, done = None, None, []
        for batch in batches:
            for *node, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if node != at:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256(body.encode())
                else:
                    sha.update(b"," + body.encode())
            if done:
                yield _digest_rows(done)
                done = []
        if at is not None:
            yield _digest_rows([(*at, sha.hexdigest())])

    def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
        d, a, b, s = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], [*key, "ends_sha256"])

    parts = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").select(*key, "conv_id").mapInArrow(chunks, "depth long, k1 long, k2 long, first long, body string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "body").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _subtree_sums(paths: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(conv_id, saved, leaves) summed over each path and all that hang below it; paths: conv_id, above, saved, leaves.

    After round i a path has the sums of those less than 2**i below it, and knows the path 2**i above."""
    i, now = 0, scratch.store(paths, "paths-0")
    while now.where("above is not null").limit(1).count():
        below = now.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        # nothing is above the root's path, so those below it need no lookup
        deep, flat = now.where(F.col("above") != root), now.where((F.col("above") == root) | F.col("above").isNull())
        up = now.where("above is not null").select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        moved = deep.join(up, "above", "left").select("conv_id", F.col("next").alias("above"), "saved", "leaves").union(flat.select("conv_id", F.lit(None).cast("long"), "saved", "leaves"))
        i += 1
        zero = F.lit(0).cast("long")
        now = scratch.store(moved.join(below, "conv_id", "left").select("conv_id", "above", (F.col("saved") + F.coalesce("s", zero)).alias("saved"), (F.col("leaves") + F.coalesce("l", zero)).alias("leaves")), f"paths-{i}")
        scratch.drop(f"paths-{i - 1}")
    return now.select("conv_id", "saved", "leaves")


def prefix_trie(conversations: DataFrame, base: Callable[[Column], Column] | None = None, taken: Callable[[Column], Column] | None = None, most: int = 5, fan: int = 512) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the keys k1, k2 of the node and p1, p2 of its parent (last_turns() finds its last turn by them).

    base(conv_id) and taken(conv_id) rebuild each conversation before: the first taken(c) turns (`most` at most) of
    conversation base(c), all if it has fewer and none if there is none, take the place of its own first taken(c) turns.
    fan: tables that are merged at a time."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    zero = F.lit(0).cast("long")
    fragments = scratch.store(_fragments(conversations), "fragments")
    placed = scratch.store(_placed(fragments), "placed")
    scratch.drop("fragments")
    c = F.col("conv_id")
    heads = scratch.store(_heads(placed, most), "heads")
    lengths = placed.groupBy("conv_id").agg(F.sum("n").alias("length"))
    starts = heads.withColumnRenamed("head", "own").join(lengths, "conv_id")
    starts = starts.withColumns({"h": (taken(c) if taken else F.lit(0)).cast("long"), "_from": base(c) if base else F.lit(None).cast("long")})
    starts = starts.join(heads.select(c.alias("_from"), F.col("head").alias("base")), "_from", "left").drop("_from")
    # of the own head only the key of what is replaced matters, all of a shorter conversation's
    tables = scratch.store(_partial_tries(placed, starts), "tables")
    scratch.drop("placed", "heads")
    slots = tables.agg(F.max("slot")).first()[0]
    if slots is None:
        empty = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, k1 long, k2 long, p1 long, p2 long"
        return spark.createDataFrame([], empty)
    nodes = _merged(tables.where("not ends").drop("ends"), slots + 1, fan, scratch)
    digests = scratch.store(_end_digests(tables.where("ends")), "ends")
    scratch.drop("tables")
    own = (F.col("n") - 1) * F.col("chars")
    # paths: the nodes of one smallest member, from the top down to the member's end
    root = nodes.where("depth = 0").first()["conv_id"]
    paths = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.max("depth").alias("end"), F.sum(own).alias("saved")).select("conv_id", "end", "saved", F.col("top.depth").alias("top"), F.col("top.p1").alias("k1"), F.col("top.p2").alias("k2"), (F.col("top.depth") - 1).alias("depth"))
    paths = scratch.store(paths, "paths")
    keyed = nodes.select(F.col("conv_id").alias("above"), "depth", "k1", "k2")
    fields = ["conv_id", "above", "top", "end", "saved"]
    hung = paths.where("top > 1").join(keyed, ["depth", "k1", "k2"]).select(*fields)
    hung = hung.union(paths.where("top <= 1").select("conv_id", F.when(F.col("top") == 1, F.lit(root).cast("long")).alias("above"), "top", "end", "saved"))
    hung = scratch.store(hung, "hung")
    below = hung.where("above is not null").groupBy(F.col("above").alias("conv_id"), (F.col("top") - 1).alias("depth"))
    has_more = below.agg(F.count("*").alias("more"))
    ended = hung.join(has_more.withColumnRenamed("depth", "end"), ["conv_id", "end"], "left").select("conv_id", "above", "saved", F.when(F.col("more").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    sums = _subtree_sums(ended, root, scratch)
    whole = hung.drop("saved").join(sums, "conv_id")
    whole = scratch.store(whole, "sums")
    # one row for each node that has something besides its own path: a top, an end, or paths that hang from it
    none = F.lit(None).cast("long")
    events = whole.select("conv_id", F.col("top").alias("depth"), F.lit(True).alias("top"), F.col("above").alias("parent"), F.lit(False).alias("end"), zero.alias("more"), zero.alias("saved"), zero.alias("leaves"))
    events = events.union(whole.select("conv_id", "end", F.lit(False), none, F.lit(True), zero, zero, zero))
    events = events.union(whole.where("above is not null").groupBy("above", F.col("top") - 1).agg(F.lit(False), F.lit(None).cast("long"), F.lit(False), F.count("*"), F.sum("saved"), F.sum("leaves")))
    events = events.groupBy("conv_id", "depth").agg(F.max("top").alias("top"), F.max("parent").alias("parent"), F.max("end").alias("end"), F.sum("more").alias("more"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    rows = nodes.join(events, ["conv_id", "depth"], "left").withColumn("segment", F.expr(f"depth div {SEGMENT}"))
    at_end, more = F.coalesce("end", F.lit(False)), F.coalesce("more", zero)
    rows = rows.select(
        "conv_id", "depth", "segment", "k1", "k2", "p1", "p2", F.col("n").alias("n_convs"),
        F.when(F.coalesce("top", F.lit(False)), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        (more + F.when(at_end, 0).otherwise(1)).alias("n_children"),
        (own + F.coalesce("saved", zero)).alias("saved"), (F.coalesce("leaves", zero) + F.when(at_end & (more == 0), 1).otherwise(0)).alias("leaves"),
    )
    rows = scratch.store(rows, "rows")
    # from the end of a path upwards: within segments, and over the sums of the segments below
    up = W.partitionBy("conv_id", "segment").orderBy(F.desc("depth"))
    long = rows.where("segment > 0").select("conv_id").distinct()
    later = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "segment").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    after = W.partitionBy("conv_id").orderBy(F.desc("segment"))
    later = later.select("conv_id", "segment", (F.sum("s").over(after) - F.col("s")).alias("s"), (F.sum("l").over(after) - F.col("l")).alias("l"))
    rows = rows.withColumns({"saved": F.sum("saved").over(up), "leaves": F.sum("leaves").over(up)}).join(later, ["conv_id", "segment"], "left")
    out = rows.join(digests, ["depth", "k1", "k2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), (F.col("leaves") + F.coalesce("l", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "k1", "k2", "p1", "p2",
    )


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """prefix_trie()'s nodes with role and text of the last turn, null at the root."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = batch.column(1).to_pylist()
            lanes = np.empty((len(depth), 2), "<u8")
            for lane, base in enumerate(BASES):
                k, p = (np.asarray(batch.column(i + lane)).view(np.uint64) for i in (2, 4))
                with np.errstate(over="ignore"):
                    lanes[:, lane] = (k - p) * np.array([_power(base, 1 - d) for d in depth], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() if d else None for x, d in zip(lanes, depth, strict=True)], pa.binary())], ["conv_id", "depth", "digest"])

    digests = nodes.select("conv_id", "depth", "k1", "k2", "p1", "p2").mapInArrow(fn, "conv_id long, depth long, digest binary")
    said = conversations.select(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = said.select(turn_digest(F.col("role"), F.col("text")).alias("digest"), "role", "text").dropDuplicates(["digest"])
    return nodes.join(digests, ["conv_id", "depth"]).join(turns, "digest", "left").drop("digest")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    trie = prefix_trie(rows, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string").cast("binary")) % 6, most=5)
    return trie.drop("k1", "k2", "p1", "p2")


OP13_SQL = r"""
WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
 t AS (SELECT conv_id, g, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS p FROM x),
 -- CRC-32 of the decimal id, byte by byte and bit by bit
 c AS (SELECT conv_id, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
   lambda a, b: list_reduce([xor(a, b)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
 r AS (SELECT c.conv_id, 0 AS part, t.p, g, chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.p <= h
   UNION ALL SELECT c.conv_id, 1, t.p, g, chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > h),
 q AS (SELECT conv_id, g, chars, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth FROM r),
 k AS (SELECT conv_id, depth, chars, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
 m AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM k GROUP BY depth, key),
 e AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(key, depth) AS key FROM k GROUP BY conv_id) GROUP BY key),
 o AS (SELECT left(key, 32 * (CAST(depth AS INT) - 1)) AS key, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL),
 l AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN o USING (key)),
 s AS (SELECT a.key, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved FROM l a JOIN l b ON starts_with(b.key, a.key) GROUP BY a.key)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, l.n_convs, CAST(l.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
 coalesce(ends, sha256('')) AS ends_sha256
FROM l JOIN s USING (key) LEFT JOIN e USING (key) LEFT JOIN m u ON l.depth > 0 AND u.key = left(l.key, 32 * (CAST(l.depth AS INT) - 1)) AND u.depth = l.depth - 1
"""
