"""Connected components by local contraction in a random order (Lacki et al. 2018)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skein.session import Scratch


#: Edges up to which one task finds all components: 16 MB. More go the distributed way.
SMALL_EDGES = 1 << 20
_LOW = (1 << 32) - 1


def _labels(table: pa.Table) -> pa.Table:
    """Smallest reachable id of each vertex: hooks roots to smaller ones and halves paths until nothing changes."""
    ends = np.concatenate([np.asarray(table["u"]), np.asarray(table["v"])])
    ids, at = np.unique(ends, return_inverse=True)
    a, b = at[: table.num_rows], at[table.num_rows :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return pa.table({"id": ids, "component": ids[label]})
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _dealt(x: Column, salt: int) -> Column:
    """Another number for every number, one to one and as if drawn by lot: the halves of 64 bits in a Feistel net of two rounds."""
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    for k in (0, 1):
        high, low = low, high.bitwiseXOR(F.hash(low, F.lit(2 * salt + k)).cast("long").bitwiseAND(F.lit(_LOW)))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _undealt(x: Column, salt: int) -> Column:
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    for k in (1, 0):
        high, low = low.bitwiseXOR(F.hash(high, F.lit(2 * salt + k)).cast("long").bitwiseAND(F.lit(_LOW))), high
    return F.shiftleft(high, 32).bitwiseOR(low)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = SMALL_EDGES) -> DataFrame:
    """(id, component) of every vertex with an edge; the component is its smallest id.

    Edges may repeat, point either way or loop; a null end is ignored. The distinct edges are written and
    counted: up to `small` of them are solved in one task. With more, every vertex moves to the first of itself and its
    neighbours, in an order dealt anew each round; the edges move along, and those that become loops or repeat go. This
    keeps what hangs together, and leaves half of a path's vertices at most, so that a round's volume is a
    part of that of the round before. Each round is written to the shared folder, which cuts the lineage and survives lost
    executors. Minima are pre-aggregated and joined back, so that a hub's edges can be split over tasks.
    """
    scratch = Scratch(edges.sparkSession, "components")
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = scratch.store(e, "e0")
    moves: list[DataFrame] = []
    while e.count() > small:
        i = len(moves)
        if i == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        u, v = _dealt(F.col("u"), i), _dealt(F.col("v"), i)
        first = e.select("u", v.alias("m")).union(e.select("v", u)).groupBy("u").agg(F.min("m").alias("m"))
        moved = scratch.store(first.select("u", _undealt(F.least("m", u), i).alias("to")), f"moves{i}")
        both = e.join(moved.select("u", F.col("to").alias("x")), "u").join(moved.select(F.col("u").alias("v"), F.col("to").alias("y")), "v").where("x <> y")
        e = scratch.store(both.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), f"e{i + 1}")
        scratch.drop(f"e{i}")
        moves.append(moved)
    out = e.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_labels, "id long, component long")
    if not moves:
        return out
    for moved in reversed(moves):
        out = moved.join(out.withColumnRenamed("id", "to"), "to", "left").select(F.col("u").alias("id"), F.coalesce("component", "to").alias("component"))
    out = scratch.store(out, "roots")
    least = out.groupBy("component").agg(F.min("id").alias("least"))
    return out.join(least, "component").select("id", F.col("least").alias("component"))
