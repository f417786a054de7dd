"""Name search, the six-threshold sweep and its forest against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import names
from skein.operators import graph, search
from skein.operators.components import connected_components

GIVEN = "ramesh ramesha suresh manjunath manjunatha prakash prakesh nagaraj ann joanna li al kiran".split()
SUR = "gowda gouda reddy kumar kumari shetty rao naik lee".split()


def _people(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = [rng.choice(GIVEN), *rng.sample(SUR, rng.randint(0, 2))]
        name = " ".join(parts)
        if rng.random() < 0.3:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("aeiou xz") + name[at + 1 :]
        out.append((i, rng.choice([name, name.title(), name.upper()]), f"p{rng.randrange(n // 2)}"))
    return out + [(n, None, "p0"), (n + 1, "ರಮೇಶ್ ಗೌಡ", "p1"), (n + 2, "", "p2"), (n + 3, "ಮಂಜುನಾಥ್", "p2")]


def test_search_finds_every_name_over_the_threshold(spark):
    people = _people(260, 3)
    queries = ["Ramesh Gowda", "ann", "a", "li lee", "manjunath", "ರಮೇಶ್", "zzz", "KUMARI naik", "rao reddy shetty", "", None]
    known = spark.createDataFrame(people, "accused_id long, name string, true string")
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    found = {(r.query, r.name) for r in search.candidates(asked, known).collect()}
    every = {(q, n) for q in queries if q for _, n, _ in people if n}
    over = {(q, n) for q, n in every if names.search_score_of(q, n) >= 0.72}
    assert over <= found and len(over) > 100
    assert len(found) < 0.5 * len(every)  # most names are never scored


def test_search_keeps_the_first_of_each_identity(spark):
    people = _people(120, 5) + [(500 + i, "Ramesh Gowda", "x") for i in range(60)]
    known = spark.createDataFrame(people, "accused_id long, name string, true string")
    groups = {i: 500 + (i - 500) // 2 * 2 for i in range(500, 560)} | {3: 3, 4: 3, 9: 3}
    queries = ["ramesh gowda", "prakash", "joanna rao"]
    g = spark.createDataFrame(list(groups.items()), "id long, component long")
    got = sorted((r.query, r.rank, r.identity, r.score, r.size) for r in search.person_searches(known, spark.createDataFrame([(q,) for q in queries], "query string"), g).collect())
    size = {c: sum(v == c for v in groups.values()) for c in set(groups.values())}
    expected = []
    for q in queries:
        hits = []
        for i, n, _ in people:
            if n and (s := round(names.search_score_of(q, n), 6)) >= 0.72:
                identity = groups.get(i, i)
                hits.append((-s, -size.get(groups.get(i), 1), i, identity))
        first = {}
        for s, n, i, identity in sorted(hits)[:40]:
            if identity not in first or (s, i) < first[identity][::2]:
                first[identity] = (s, n, i)
        order = sorted((s, n, identity) for identity, (s, n, _) in first.items())[:8]
        expected += [(q, r, identity, -s, -n) for r, (s, n, identity) in enumerate(order, 1)]
    assert got == sorted(expected)


def _components(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_one_forest_has_the_components_of_every_threshold(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, rng.choice([0.8, 0.83, 0.86, 0.9, 0.93, 0.97])) for a, b in (sorted(rng.sample(range(50), 2)) for _ in range(110))]
    df = spark.createDataFrame(edges, "a long, b long, s double")
    forest = [tuple(r) for r in graph.strongest_forest(df).collect()]
    ids = set(itertools.chain.from_iterable(e[:2] for e in edges))
    assert len(forest) == len(ids) - len(set(_components(ids, [e[:2] for e in edges]).values()))
    got = {}
    for r in graph.components_by_threshold(spark.createDataFrame(forest, "a long, b long, s double"), graph.SWEEP).collect():
        got[r.threshold, r.id] = r.component
    for t in graph.SWEEP:
        expected = _components(ids, [(a, b) for a, b, s in edges if s >= t])
        assert {i: got.get((t, i), i) for i in ids} == expected


def test_sweep_counts_pairs_as_brute_force(spark):
    people = [(i, n, p) for i, n, p in _people(150, 9) if n and not names.re.search("[ಀ-೿]", n)]
    df = spark.createDataFrame(people, "id long, name string, true_person string")
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in graph.fuzzy_sweep(df).collect()}
    sound = {r.name: r.k for r in df.select("name", F.soundex(F.regexp_replace(F.element_at(F.split(F.lower(F.trim("name")), r"\s+"), 1), "[^a-z]", "")).alias("k")).collect()}
    for t in graph.SWEEP:
        edges = [(i, j) for (i, x, _), (j, y, _) in itertools.combinations(people, 2) if sound[x] == sound[y] and names.jaro_winkler_of(x.lower().strip(), y.lower().strip()) >= t]
        comp = _components([p[0] for p in people], edges)
        found = {(a[0], b[0]) for a, b in itertools.combinations(people, 2) if comp[a[0]] == comp[b[0]]}
        truth = {(a[0], b[0]) for a, b in itertools.combinations(people, 2) if a[2] == b[2]}
        assert got[t] == (len(found & truth), len(found - truth), len(truth - found))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graph.fuzzy_sweep(spark.createDataFrame([], "id long, name string, true_person string")).count() == 0
