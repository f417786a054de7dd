"""Greedy groups against a sequential sweep."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import analytics, greedy

ITEMS = ["entry:door", "entry:roof", "tool:rod", "approach:night", "target:shop"]


def _swept(rank, edges, items, least, common):
    near = {}
    for a, b in sorted({(a, b) for a, b in edges if a != b and a in rank and b in rank}):
        near.setdefault(a, []).append(b)
    groups = greedy.sweep(sorted(rank, key=lambda v: (rank[v], v)), near, set(rank), {k: frozenset(v) for k, v in items.items()}, least, common)
    return sorted((g[0], x) for g in groups for x in g)


@pytest.mark.parametrize("small,least,common", [(0, 2, 2), (60, 3, 1), (1 << 16, 3, 2)])
def test_rounds_equal_the_sweep(spark, small, least, common):
    rng = random.Random(small + 10 * least + common)
    n = 30
    rank = {i: rng.randrange(40) for i in range(n)}  # many ties
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(32)] + [(i, i + 1) for i in range(18, 28)]
    edges = edges + [(b, a) for a, b in edges] + [(3, 3), (5, 999), (999, 5)]
    items = {i: rng.sample(ITEMS, rng.randint(0, 5)) for i in range(n)}
    v = spark.createDataFrame([(i, rank[i], items[i], "x") for i in range(n)], "id long, rank long, items array<string>, seed string")
    got = greedy.greedy_groups(v, spark.createDataFrame(edges, "a long, b long"), least, common, small)
    assert sorted(map(tuple, got.collect())) == _swept(rank, edges, items, least, common)


def test_nothing_to_group(spark):
    v = spark.createDataFrame([], "id long, rank long")
    assert greedy.greedy_groups(v, spark.createDataFrame([], "a long, b long"), 2).count() == 0
    with pytest.raises(ValueError, match="two members"):
        greedy.greedy_groups(v, v, 1)


def test_one_large_component_is_spread_over_tasks(spark):
    """A component of 10**5 vertices goes by rounds: no task gets it whole."""
    n = 100_000
    ids = spark.range(n)
    rank = F.xxhash64("id").bitwiseAND(F.lit(2**40 - 1))
    edges = ids.where(f"id < {n - 1}").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    both = edges.union(edges.select("b", "a"))
    got = greedy.greedy_groups(ids.select("id", rank.alias("rank")), both, 2, small=1000)
    ranks = {r.id: r.rank for r in ids.select("id", rank.alias("rank")).collect()}
    near = {i: [x for x in (i - 1, i + 1) if 0 <= x < n] for i in range(n)}
    expected = greedy.sweep(sorted(ranks, key=lambda v: (ranks[v], v)), near, set(ranks), {}, 2, 0)
    assert sorted(map(tuple, got.collect())) == sorted((g[0], x) for g in expected for x in g)


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_clusters_of_the_given_orders(spark, small):
    from skein.plans.registry import Tables
    from skein.plans.star_queries import placed

    t = Tables(spark, "/root/testdata/sf0.001")
    cases = placed(t)
    got = analytics.near_repeat_clusters(cases, metres=900, small=small).collect()
    pairs = {(r.case_id, r.other) for r in analytics.near_repeats(cases, 900).collect()}
    days = {r.case_id: r.registered.toordinal() for r in cases.collect()}
    expected = {}
    for seed, x in _swept({k: -d for k, d in days.items()}, pairs, {}, 3, 0):
        expected.setdefault(seed, []).append(x)
    assert {r.cluster: r.cases for r in got} == {k: sorted(v) for k, v in expected.items()} and expected
