"""Exact top-k search by KD-trees per shard (operator 1).

Rows are hashed into shards of a bounded number of vectors. Each shard is a KD-tree: a node splits
at the median of its box's widest side, down to leaves, and keeps the tight bounding box of its
vectors and its smallest id. The trees are written with all their nodes as one row a shard.

A search meets blocks of queries with shards. For a query, a box bounds the inner product from above
by the sum over components of the larger of query * low and query * high. Nodes are taken from a queue
in the order of their bounds, from the root; the search of a shard ends at the first node that can't beat the k-th
score so far (with equal scores: whose smallest id is no smaller than the k-th id). The k-th score is
propagated: every query first searches the one shard it is hashed to, and that result is the bar
with which it enters all other shards.

Scores are sums of products of integers; they are taken as doubles where every partial sum stays
below 2**53, and as 64-bit integers otherwise. Vectors that are equal fall into leaves of a box
without extent; ids in order make such leaves end a search early.

Defined cases: null, empty or non-finite vectors (or with a null component) take no part; nor do null ids; vectors
of different lengths are not comparable and never meet; rows that repeat an id and a vector count
once; if one id has several vectors, the best score of each pair of ids counts; a query's own id is
no candidate; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from skein.llm.texts import blocks_for
from skein.session import Scratch, settings

SHARD_ROWS = 1 << 14
QUERY_ROWS = 1 << 10
LEAF_ROWS = 64
FOUND = "query_id long, vec_id long, score long"


class Tree:
    """A KD-tree over the rows of `v`, reordered so that each leaf is a slice. Nodes stand level by level: `kids` is the
    first of a node's two children, or -1 for a leaf, whose rows are begin..end; low and high are the tight boxes."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.lexsort((*v.T[::-1], ids)) if v.shape[1] else np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (v[1:] != v[:-1]).any(1)] if len(ids) else np.zeros(0, bool)
        ids, v = ids[new], v[new]
        nodes, kids = [np.arange(len(ids))] if len(ids) else [], []
        while len(kids) < len(nodes):
            rows = nodes[len(kids)]
            if len(rows) <= leaf:
                kids.append(-1)
                continue
            kids.append(len(nodes))
            part = v[rows]
            side = int(np.argmax(part.max(0) - part.min(0)))
            half = len(rows) // 2
            # stable, and rows stand in the order of ids: equal vectors stay in that order
            split = rows[np.argsort(part[:, side], kind="stable")]
            nodes += [np.sort(split[:half]), np.sort(split[half:])]
        self.kids = np.array(kids, np.int64)
        size = np.array([len(r) if k < 0 else 0 for r, k in zip(nodes, kids, strict=True)], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        rows = np.concatenate([r for r, k in zip(nodes, kids, strict=True) if k < 0]) if nodes else np.zeros(0, int)
        self.ids, self.v = ids[rows], v[rows]
        self.low = np.array([v[r].min(0) for r in nodes]).reshape(len(nodes), v.shape[1])
        self.high = np.array([v[r].max(0) for r in nodes]).reshape(len(nodes), v.shape[1])
        self.least = np.array([ids[r].min() for r in nodes], np.int64)


def _exact(q: np.ndarray, v: np.ndarray) -> type:
    """The number type in which inner products of these integers are exact."""
    a, b = (float(np.abs(x.astype(float)).max()) if x.size else 0.0 for x in (q, v))
    return np.float64 if a * b * max(1, q.shape[1]) < 2**53 else np.int64


def search(qids: np.ndarray, q: np.ndarray, bar: np.ndarray, bar_id: np.ndarray, tree: Tree, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of at most k best rows of the tree for each query that may still enter its
    overall result: bar is the query's k-th score so far and bar_id that row's id."""
    kind = _exact(q, tree.v)
    qx, v = q.astype(kind), tree.v.astype(kind)
    bounds = _bounds(qx, bar, bar_id, tree, kind)
    kids, begin, end, least = tree.kids.tolist(), tree.begin.tolist(), tree.end.tolist(), tree.least.tolist()
    out = []
    for i in range(len(q)):
        bound = bounds[i].tolist()
        ids, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        kth, kth_id = bar[i].item(), bar_id[i].item()
        heap = [(-bound[0], least[0], 0)] if bound else []
        step = 1  # leaves that are scored at a time
        while heap:
            now: list[int] = []
            while heap and len(now) < step:
                b, first, node = heapq.heappop(heap)
                if -b < kth or (-b == kth and first >= kth_id):
                    heap.clear()  # nor can any node behind it
                    break
                if kids[node] < 0:
                    now.append(node)
                    continue
                for x in (kids[node], kids[node] + 1):
                    if bound[x] > kth or (bound[x] == kth and least[x] < kth_id):
                        heapq.heappush(heap, (-bound[x], least[x], x))
            step = min(4 * step, 64)
            if not now:
                break
            rows = np.concatenate([np.arange(begin[j], end[j]) for j in now])
            rows = rows[tree.ids[rows] != qids[i]]
            ids, scores = np.r_[ids, tree.ids[rows]], np.r_[scores, v[rows] @ qx[i]]
            best = np.lexsort((ids, -scores))
            ids, scores = ids[best], scores[best]
            _, once = np.unique(ids, return_index=True)  # an id counts with its best score
            once.sort()
            ids, scores = ids[once][:k], scores[once][:k]
            if len(ids) == k and (scores[-1] > kth or (scores[-1] == kth and ids[-1] < kth_id)):
                kth, kth_id = scores[-1].item(), ids[-1].item()
        ok = (scores > bar[i]) | ((scores == bar[i]) & (ids < bar_id[i]))
        out += [(int(qids[i]), int(a), int(s)) for a, s in zip(ids[ok], scores[ok], strict=True)]
    return out


def _bounds(q: np.ndarray, bar: np.ndarray, bar_id: np.ndarray, tree: Tree, kind: type) -> np.ndarray:
    """For each query and node the most that an inner product can be in the node's box. Levels are worked out from the root,
    for all queries at once; nothing below a node that no query can enter is looked at."""
    low, high, up, down = tree.low.astype(kind), tree.high.astype(kind), np.maximum(q, 0), np.minimum(q, 0)
    out = np.full((len(q), len(tree.kids)), NO_SCORE, kind)
    nodes = np.arange(min(1, len(tree.kids)))
    while len(nodes):
        b = up @ high[nodes].T + down @ low[nodes].T
        out[:, nodes] = b
        enter = ((b > bar[:, None]) | ((b == bar[:, None]) & (tree.least[nodes] < bar_id[:, None]))).any(0)
        inner = tree.kids[nodes[enter]]
        inner = inner[inner >= 0]
        nodes = np.sort(np.r_[inner, inner + 1])
    return out


def _valid(vector: Column) -> Column:
    return (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, dim)


def _group_tree(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    tree = Tree(np.asarray(table["vec_id"]), _matrix(table["v"], dim))
    cells = {"ids": tree.ids.astype("<i8"), "v": tree.v.astype("<i8"), "kids": tree.kids.astype("<i8"), "begin": tree.begin.astype("<i8"), "end": tree.end.astype("<i8"), "low": tree.low.astype("<i8"), "high": tree.high.astype("<i8"), "least": tree.least.astype("<i8")}
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in cells.items()}})


def _read_tree(row: dict) -> Tree:
    tree = object.__new__(Tree)
    dim = row["dim"]
    for c in ("ids", "kids", "begin", "end", "least"):
        setattr(tree, c, np.frombuffer(row[c], "<i8"))
    for c in ("v", "low", "high"):
        setattr(tree, c, np.frombuffer(row[c], "<i8").reshape(-1, dim))
    return tree


def _group_queries(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    cells = {"qids": np.asarray(table["vec_id"]).astype("<i8"), "q": _matrix(table["v"], dim).astype("<i8"), "bar": np.asarray(table["bar"]).astype("<i8"), "bar_id": np.asarray(table["bar_id"]).astype("<i8")}
    return pa.table({"dim": pa.array([dim], pa.int32()), "home": pa.array([table["home"][0].as_py()], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in cells.items()}})


TREES = "dim int, shard long, ids binary, v binary, kids binary, begin binary, end binary, low binary, high binary, least binary"
QUERIES = "dim int, home long, qids binary, q binary, bar binary, bar_id binary"
#: Below every score, with an id above every id: what enters an unfilled result.
NO_SCORE, NO_ID = -(2**63) + 1, 2**63 - 1


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                qids, bar, bar_id = (np.frombuffer(row[c], "<i8") for c in ("qids", "bar", "bar_id"))
                got = search(qids, np.frombuffer(row["q"], "<i8").reshape(-1, row["dim"]), bar, bar_id, _read_tree(row), k)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(fn, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of `vectors` by inner product.

    Both inputs have vec_id (long) and v (array of long).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kd-search")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"))
    n = blocks_for(rows.count(), shard_rows)
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n))
    trees = scratch.store(rows.withColumn("shard", shard).groupBy("dim", "shard").applyInArrow(_group_tree, TREES), "trees")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim")).distinct().withColumn("home", shard)

    def blocks(q: DataFrame) -> DataFrame:
        # some blocks for each home shard, of about query_rows queries
        salted = q.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks_for(asked_rows, query_rows * n))))
        return salted.groupBy("dim", "home", "salt").applyInArrow(_group_queries, QUERIES)

    asked_rows = asked.count()
    first = blocks(asked.withColumn("bar", F.lit(NO_SCORE)).withColumn("bar_id", F.lit(NO_ID)))
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}):
        home = scratch.store(_ranked(_searched(first.join(trees, (first.dim == trees.dim) & (first.home == trees.shard)).drop(trees.dim), k), k), "home")
        bars = home.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bar"), F.col("vec_id").alias("bar_id"))
        barred = asked.join(bars, "vec_id", "left").select("vec_id", "v", "dim", "home", F.coalesce("bar", F.lit(NO_SCORE)).alias("bar"), F.coalesce("bar_id", F.lit(NO_ID)).alias("bar_id"))
        # each block of queries visits the other shards: their numbers are known, so this is an equi-join
        rest = blocks(barred).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).where("shard <> home")
        found = scratch.store(_searched(rest.join(trees, ["dim", "shard"]), k), "found")
    scratch.drop("trees")
    return _ranked(home.select("query_id", "vec_id", "score").union(found), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(_valid(F.col("embedding")))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))
    return top_k(whole, whole.where("vec_id % 50 = 0"))


OP1_SQL = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
