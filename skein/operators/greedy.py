"""Greedy groups around seeds, as a sequential sweep would make them, but in rounds over a distributed graph.

The sweep: vertices come in the order of their rank. One that is not used yet takes its unused neighbours; if the group
is large enough, and what its members have in common is enough, all of them are used, else none of them.

A vertex can decide as soon as no earlier undecided one can reach any vertex of its group: its outcome is then what
the sweep would find at its turn, so all such vertices decide in one round. Those whose free neighbours are too few
can only fail, and are decided at once. The earliest undecided vertex can always decide, so the rounds end. What has been
decided leaves the graph, and so do edges that no undecided vertex has; a remainder of up to `small`
edges is swept in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from skein.functions import stats
from skein.operators.components import connected_components
from skein.session import Scratch

#: Edges that one task sweeps: about 2 MB.
SMALL_EDGES = 1 << 16


def sweep(order: list[int], near: dict[int, list[int]], seeds: set[int], items: dict[int, frozenset], least: int, common: int) -> list[list[int]]:
    """The groups, each with its seed first."""
    used, out = set(), []
    for v in order:
        if v in used or v not in seeds:
            continue
        group = [v, *(x for x in near.get(v, ()) if x not in used)]
        if len(group) >= least and (not common or len(frozenset.intersection(*(items[x] for x in group))) >= common):
            used.update(group)
            out.append(group)
    return out


def _swept(least: int, common: int):
    def fn(table: pa.Table) -> pa.Table:
        near: dict[int, list[int]] = {}
        rank: dict[int, int] = {}
        seeds, items = set(), {}
        for r in table.to_pylist():
            near.setdefault(r["a"], []).append(r["b"])
            rank[r["a"]], items[r["a"]] = r["rank"], frozenset(r["items"] or ())
            if r["seed"]:
                seeds.add(r["a"])
        groups = sweep(sorted(rank, key=lambda v: (rank[v], v)), near, seeds, items, least, common)
        pairs = [(g[0], x) for g in groups for x in g]
        return pa.table({"seed": pa.array([p[0] for p in pairs], pa.int64()), "id": pa.array([p[1] for p in pairs], pa.int64())})

    return fn


def greedy_groups(vertices: DataFrame, edges: DataFrame, least: int, common: int = 0, small: int = SMALL_EDGES, max_rounds: int = 10_000) -> DataFrame:
    """(seed, id): the members of each group, the seed included.

    vertices: id, rank (long; ties go by id) and, where `common` is over 0, items (array<string>), of which all members of a
    group must share so many. edges: a, b in both directions; loops, repeated edges and edges to unknown vertices are
    left out. A vertex alone is no group: `least` is 2 or more."""
    if least < 2:
        raise ValueError("a group has two members at least")
    spark = edges.sparkSession
    scratch = Scratch(spark, "greedy")
    items = F.col("items") if "items" in vertices.columns else F.array().cast("array<string>")
    v = scratch.store(vertices.select(F.col("id").cast("long"), F.col("rank").cast("long"), items.alias("items"), F.lit(True).alias("seed")), "w0")
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct()
    e = scratch.store(e.join(v.select(F.col("id").alias("a")), "a", "left_semi").join(v.select(F.col("id").alias("b")), "b", "left_semi"), "f0")
    found = []
    for i in range(1, max_rounds + 1):
        # vertices with too few free neighbours can only fail
        degree = e.groupBy(F.col("a").alias("id")).agg((F.count("*") + 1).alias("most"))
        v = scratch.store(v.join(degree, "id").select("id", "rank", "items", (F.col("seed") & (F.col("most") >= least)).alias("seed")), f"v{i}")
        open_ = v.where("seed").select("id", F.struct("rank", "id").alias("key"))
        # edges with an undecided end
        live = e.join(open_.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a", "left").join(open_.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b", "left")
        e = scratch.store(live.where("ka is not null or kb is not null").select("a", "b", "ka", "kb"), f"e{i}")
        scratch.drop(f"w{i - 1}", f"f{i - 1}")
        n = e.count()
        if not n:
            break
        if n <= small:
            rows = e.select("a", "b").join(v.withColumnRenamed("id", "a"), "a").withColumn("one", F.lit(1))
            found.append(scratch.store(rows.groupBy("one").applyInArrow(_swept(least, common), "seed long, id long"), "rest"))
            break
        # the earliest undecided vertex that reaches x, and the earliest of those over all x that v reaches
        reach = e.where("kb is not null").select(F.col("a").alias("x"), F.col("kb").alias("key")).union(open_.select("id", "key")).groupBy("x").agg(F.min("key").alias("first"))
        seen = e.where("ka is not null").select(F.col("a").alias("id"), "ka", F.col("b").alias("x")).union(open_.select("id", "key", "id")).join(reach, "x")
        ready = seen.groupBy("id").agg(F.min("first").alias("first"), F.first("ka").alias("key")).where("first = key").select("id")
        groups = ready.select(F.col("id").alias("seed"), "id").union(e.join(ready.select(F.col("id").alias("a")), "a").select("a", "b"))
        groups = scratch.store(groups, f"tried{i}")
        taken = groups
        if common:
            size = groups.groupBy("seed").agg(F.count("*").alias("n"))
            shared = groups.join(v.select("id", F.explode(F.array_distinct("items")).alias("item")), "id").groupBy("seed", "item").agg(F.count("*").alias("c"))
            enough = shared.join(size, "seed").where("c = n").groupBy("seed").agg(F.count("*").alias("c")).where(F.col("c") >= common).select("seed")
            taken = groups.join(enough, "seed", "left_semi")
        taken = scratch.store(taken, f"taken{i}")
        found.append(taken)
        tried = groups.select(F.col("seed").alias("id")).distinct().withColumn("tried", F.lit(True))
        v = scratch.store(v.join(taken.select("id"), "id", "left_anti").join(tried, "id", "left").select("id", "rank", "items", (F.col("seed") & F.col("tried").isNull()).alias("seed")), f"w{i}")
        e = scratch.store(e.select("a", "b").join(taken.select(F.col("id").alias("a")), "a", "left_anti").join(taken.select(F.col("id").alias("b")), "b", "left_anti"), f"f{i}")
        scratch.drop(f"v{i}", f"e{i}", f"tried{i}")
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    return reduce(DataFrame.union, found, spark.createDataFrame([], "seed long, id long"))


def _swept_classes(least: int, common: int):
    """The sweep over the classes of one component, until a seed is needed that is not among the known ids: then a row without
    a seed tells the place (`at`) that the sweep has come to."""

    def fn(table: pa.Table) -> pa.Table:
        rows = {r["cls"]: r for r in table.to_pylist()}
        near = {c: {c, *(x for x in r["near"] or () if x in rows)} for c, r in rows.items()}
        items = {c: frozenset(r["items"] or ()) for c, r in rows.items()}
        at = next(iter(rows.values()))["at"]
        out: list[tuple] = []
        free, changed, able = set(rows), set(rows), set()
        while True:
            for c in changed & free:
                group = near[c] & free
                enough = sum(rows[x]["n"] for x in group) >= least
                (able.add if enough and (not common or len(frozenset.intersection(*(items[x] for x in group))) >= common) else able.discard)(c)
            known, unknown = [], []
            for c in able & free:
                ids = rows[c]["ids"] or []
                k = 0 if at is None else bisect_right(ids, at)
                if k < len(ids):
                    known.append((ids[k], c))
                elif rows[c]["more"]:
                    unknown.append(max([ids[-1]] if at is None else [at, ids[-1]]))
            seed, c = min(known, default=(None, None))
            if unknown and (seed is None or min(unknown) < seed):
                out += [(None, c, at) for c in free]
                break
            if seed is None:
                break
            group = near[c] & free
            out += [(seed, x, None) for x in group]
            free -= group
            at, changed = seed, set().union(*(near[x] for x in group))
        return pa.table({"seed": pa.array([r[0] for r in out], pa.int64()), "cls": pa.array([r[1] for r in out], pa.int64()), "at": pa.array([r[2] for r in out], pa.int64())})

    return fn


def class_groups(members: DataFrame, classes: DataFrame, edges: DataFrame, least: int, common: int = 0, shown: int = 64) -> DataFrame:
    """(seed, cls): the groups of the sweep over members (id, cls), smallest id first, where neighbours are the members of one
    class, and those of two classes with an edge (a, b; both directions). Ids are unique; classes: cls, items.

    No pairs of members are formed. A group takes all that is left of the classes that its seed meets, so a class is used as a
    whole or not at all, and its members fail alike until a class beside it is used. So classes are swept, a component of them in one
    task; of each class the next `shown` ids are known there, and where more are needed another round brings them."""
    spark = members.sparkSession
    scratch = Scratch(spark, "classes")
    ids = members.select(F.col("id").cast("long"), F.col("cls").cast("long")).dropna()
    e = scratch.store(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    sizes = ids.groupBy("cls").agg(F.count("*").alias("n"))
    lists = e.groupBy(F.col("a").alias("cls")).agg(F.collect_list("b").alias("near"))
    component = connected_components(e).select(F.col("id").alias("cls"), "component")
    c = sizes.join(classes.select(F.col("cls").cast("long"), F.col("items")), "cls").join(lists, "cls", "left").join(component, "cls", "left")
    c = scratch.store(c.withColumns({"component": F.coalesce("component", "cls"), "at": F.lit(None).cast("long")}), "classes0")
    found, i = [], 0
    while True:
        # the next ids of each class; one id more tells whether there are more
        rest = ids.join(c.select("cls", "at"), "cls").where("at is null or id > at")
        first = rest.withColumn("_n", F.row_number().over(W.partitionBy("cls").orderBy("id"))).where(F.col("_n") <= shown + 1)
        first = first.groupBy("cls").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        known = c.join(first, "cls", "left").withColumns({"more": F.coalesce(F.size("ids") > shown, F.lit(False)), "ids": F.slice("ids", 1, shown)})
        done = scratch.store(known.groupBy("component").applyInArrow(_swept_classes(least, common), "seed long, cls long, at long"), f"swept{i}")
        found.append(done.where("seed is not null").select("seed", "cls"))
        open_ = done.where("seed is null").select("cls", "at")
        if open_.isEmpty():
            return reduce(DataFrame.union, found)
        i += 1
        c = scratch.store(c.drop("at").join(open_, "cls"), f"classes{i}")


#: A tile is twice this many radii wide, and its task holds the places that far around it; a round goes back so many spans of days.
_REACH, _SPANS = 8, 6
#: Rows of a round, where its days can be fewer.
_ROUND_ROWS = 1 << 22


def _tile(metres: float, days: int, least: int):
    """The part of the sweep that a tile is sure of: (seed, id) of the groups of its own seeds, (null, id) of those that made none.

    A place near the border misses neighbours, so what it takes is unsure, and so is what others take after it. Unsure are all
    places in the cells, a quarter of the radius wide, that an unsure seed reaches: `since` is the day of the latest such seed."""

    def fn(table: pa.Table) -> pa.Table:
        t = {c: table[c].to_numpy() for c in ("id", "lat", "lon", "day", "seed", "core", "whole")}
        order = np.lexsort((t["id"], -t["day"]))
        t = {c: v[order] for c, v in t.items()}
        lat, lon, day = np.radians(t["lat"]), np.radians(t["lon"]), t["day"].astype(np.int64)
        unit = metres / 111_000.0
        row = np.floor(t["lat"] / unit).astype(np.int64)
        base = int(day.min()) - days - 1
        width = int(day.max()) + days + 1 - base
        key = row * width + (day - base)
        by_key = np.argsort(key, kind="stable")
        keys = key[by_key]
        east = (t["lon"] - t["lon"][0] + 180) % 360  # a tile may lie across the date line
        y = np.floor(t["lat"] / unit * 4).astype(np.int64)
        x = np.floor(east * max(0.0, np.cos(np.abs(lat).max() + np.radians(unit))) / unit * 4).astype(np.int64)
        y, x = y - y.min() + 4, x - x.min() + 4
        far = np.iinfo(np.int64).max
        since = np.full((int(y.max()) + 5, int(x.max()) + 5), far)
        used = np.zeros(len(day), bool)
        seeds, ids = [], []
        for v in np.flatnonzero(t["seed"]).tolist():
            if used[v]:
                continue
            d, r, c = day[v], y[v], x[v]
            if t["whole"][v] and since[r, c] > d + days:
                at = [row[v] * width + (d - base) + k * width for k in (-1, 0, 1)]
                near = np.concatenate([by_key[np.searchsorted(keys, k - days) : np.searchsorted(keys, k + days, "right")] for k in at])
                near = near[~used[near] & (near != v)]
                h = np.sin((lat[near] - lat[v]) / 2) ** 2 + np.cos(lat[v]) * np.cos(lat[near]) * np.sin((lon[near] - lon[v]) / 2) ** 2
                near = near[2 * stats.EARTH_M * np.arcsin(np.minimum(np.sqrt(h), 1.0)) <= metres]
                sure = int((since[y[near], x[near]] > day[near] + days).sum())
                if sure == len(near) or sure + 1 >= least:
                    if len(near) + 1 >= least:  # whoever takes them, all are used from here on
                        used[near], used[v] = True, True
                        if sure == len(near) and t["core"][v]:
                            ids += [t["id"][v], *t["id"][near]]
                            seeds += [t["id"][v]] * (1 + len(near))
                    elif t["core"][v]:
                        ids.append(t["id"][v])
                        seeds.append(None)
                    continue
            since[r - 4 : r + 5, c - 4 : c + 5] = d
        return pa.table({"seed": pa.array(seeds, pa.int64()), "id": pa.array(ids, pa.int64())})

    return fn


def near_groups(rows: DataFrame, metres: float, days: int, least: int, most: int = _ROUND_ROWS) -> DataFrame:
    """(seed, id): the groups of the sweep over rows (id, lat, lon, day), newest first, ties to the smaller id; neighbours are those within
    `metres` and `days`. Ids are unique.

    No pairs are formed: rounds go back in time, and in each one the tiles of the map decide what they can be sure of. The newest
    undecided row always is, so the rounds end; how many there are follows from the days, not from the number of rows."""
    if least < 2:
        raise ValueError("a group has two members at least")
    spark = rows.sparkSession
    scratch = Scratch(spark, "near-groups")
    number = F.datediff("day", F.lit("1970-01-01"))
    base = rows.select(F.col("id").cast("long"), F.col("lat").cast("double"), F.col("lon").cast("double"), number.alias("day")).dropna()
    base = scratch.store(base.repartitionByRange("day"), "rows")
    per_day = dict(base.groupBy("day").count().collect())  # one row a day of the calendar
    wide, inner = metres * _REACH, (_REACH - 1) / _REACH
    done = spark.createDataFrame([], "seed long, id long, day int")
    schema, i = done.schema, 0
    front = max(per_day, default=None)
    while front is not None:
        low = front - 2 * days
        held = sum(n for d, n in per_day.items() if low <= d <= front + days)
        while low > front - _SPANS * days and held + per_day.get(low - 1, 0) <= most:
            low -= 1
            held += per_day.get(low, 0)
        span = F.col("day").between(low, front + days)
        known = done.where(span).select("id", F.col("seed").isNotNull().alias("taken"))
        live = base.where(span).join(known, "id", "left").where("taken is null or not taken").withColumn("seed", F.col("taken").isNull()).drop("taken")
        live = scratch.store(live, f"live{i}")
        whole = (F.col("day") - days >= low) | F.lit(low <= min(per_day))
        place = live.withColumns({"own": stats.place_cell(F.col("lat"), F.col("lon"), wide), "inner": stats.cells_around(F.col("lat"), F.col("lon"), wide, inner), "cell": F.explode(stats.cells_around(F.col("lat"), F.col("lon"), wide))})
        place = place.select("id", "lat", "lon", "day", "seed", (F.col("cell") == F.col("own")).alias("core"), (whole & F.array_contains("inner", F.col("cell"))).alias("whole"), "cell.*")
        # tiles are few and large: a number of partitions keeps Spark from putting them together
        decided = place.repartition(64, "band", "x", "y").groupBy("band", "x", "y").applyInArrow(_tile(metres, days, least), "seed long, id long")
        scratch.store(decided.join(live.select("id", "day"), "id").select("seed", "id", "day"), f"done/{i}")
        done = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(scratch.path("done"))
        front = live.where("seed").join(done.where(span).select("id"), "id", "left_anti").agg(F.max("day")).first()[0]
        scratch.drop(f"live{i}")
        front, i = (front if front is not None else max((d for d in per_day if d < low), default=None)), i + 1
    return done.where("seed is not null").select("seed", "id")
