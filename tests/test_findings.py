"""Cases that were found wrong or too large in a review."""

import datetime
import glob
import itertools
import math
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__
from skein.functions import stats
from skein.operators import analytics, components, governance, graph, greedy, retrieval
from skein.session import Scratch
from skein.streaming.near import near_repeat_stream


def _same_as_sql(spark, name, folder, **tables):
    """The query's rows and its SQL's, over tables given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"CREATE TABLE {table} AS {sql}")
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, __spark_entry__.queries()[name](spark, str(folder)).collect()), key=str)
    want = sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=str)
    assert got == want


def test_lexicon_tags_beside_letters_beyond_ascii(spark, tmp_path):
    texts = ["éla", "delé", "eſt", "der dıe", "of theé", "中the and", "été_la", "la", "QUE", ""]
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    _same_as_sql(spark, "t18_lexicon_tags", tmp_path, documents=f"SELECT * FROM (VALUES {rows}, (99, NULL)) t(doc_id, text)")


def test_timeline_names_a_case_once_for_two_identities(spark):
    cases = spark.sql("SELECT c AS case_id, CAST('2024-01-01' AS DATE) AS registered, CAST('2024-01-01 10:00' AS TIMESTAMP) AS occurred, 'Robbery' AS crime FROM VALUES (1L), (2L) t(c)")
    accused = spark.createDataFrame([(11, 1, "Ann Lee"), (12, 1, "Ann Lee"), (21, 2, "Ann Lee"), (22, 2, "Ann Lee")], "accused_id long, case_id long, name string")
    groups = spark.createDataFrame([(11, 11), (21, 11), (12, 12), (22, 12)], "id long, component long")
    arrests = spark.createDataFrame([], "case_id long, accused_id long, arrested_on date")
    linked = governance.timeline(cases, accused, arrests, groups).where(F.col("kind") == "LINKED PRIOR OFFENCE")
    assert sorted(r.case_id for r in linked.collect()) == [1, 2]


def test_money_trails_shuffle_no_row_for_each_case_that_an_account_reaches(spark):
    n = range(300)
    own = spark.createDataFrame([(i, f"FinancialAccount:a{i % 7}") for i in n] + [(999, "FinancialAccount:lost"), (5, "FinancialAccount:a5")], "case_id long, entity string")
    cases = spark.createDataFrame([(i, None if i % 50 == 0 else f"D{i % 3}") for i in n], "case_id long, district string")
    accused = spark.createDataFrame([(10 * i + j, i) for i in n for j in (1, 2)], "accused_id long, case_id long")
    groups = {10 * i + j: (i % 40 if j == 1 else 100 + i % 9) for i in n for j in (1, 2) if i % 6}
    trails = analytics.money_trails(own, cases, accused, spark.createDataFrame(list(groups.items()), "id long, component long"))
    got = {r.account: (r.n_cases, r.n_identities, r.n_districts, r.reachable) for r in trails.collect()}
    of_case = {i: {groups[k] for k in (10 * i + 1, 10 * i + 2) if k in groups} for i in n}
    for a in range(7):
        mine = [i for i in n if i % 7 == a]
        who = set().union(*(of_case[i] for i in mine))
        reach = sorted(set(mine) | {i for i in n if of_case[i] & who})
        assert got[f"a{a}"] == (len(mine), len(who), len({i % 3 for i in reach if i % 50}), reach)
    assert "lost" not in got
    plan = trails._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(account#\d+, case_id", plan)


def test_comparable_cases_shuffle_no_pairs(spark):
    rows = [(i, "Theft" if i % 2 else None, f"D{i % 3}" if i % 5 else None, None if i % 11 == 0 else 10 + (i * 37 % 101) / 2000, 20 + (i * 53 % 97) / 2000, None) for i in range(400)]
    rows += [(7, "Theft", "D9", 40.0, 40.0, None), (1000, "Theft", "D9", 10.0, 20.0, None)]
    table = spark.createDataFrame(rows, "case_id long, crime string, district string, lat double, lon double, registered date")
    peers = analytics.comparable(table.where("case_id <> 7"), limit=5)
    assert "Exchange" not in peers._jdf.queryExecution().executedPlan().toString()

    def metres(a, b):
        h = math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    for repeated, got in ((False, peers), (True, analytics.comparable(table, limit=5))):
        known, found = [r for r in rows if repeated or r[0] != 7], {}
        first = {d: sorted(r[0] for r in known if r[1] and r[2] == d)[:6] for d in ("D0", "D1", "D2", "D9")}
        for a in known:
            same = {b for b in first.get(a[2], ()) if a[1]}
            near = {b[0] for b in known if a[1] and b[1] == a[1] and None not in (a[3], b[3]) and metres(a, b) <= 5000}
            found.setdefault(a[0], set()).update((same | near) - {a[0]})
        want = {(k, p) for k, v in found.items() for p in sorted(v)[:5]}
        assert {(r.case_id, r.peer) for r in got.collect()} == want


def test_groups_without_decisions_are_those_of_the_decisions(spark):
    rng = random.Random(5)
    cases = spark.createDataFrame([(i, " ".join(f"Phone +91{9_000_000_000 + rng.randrange(40)}." for _ in range(rng.randrange(3)))) for i in range(150)], "case_id long, facts string")
    known = ["Ravi Kumar", "Ravi Kumara", "Ravee Kumar", "Asha Rao", "Asha", "", " ", None, "ರವಿ ಕುಮಾರ್"]
    people = [(10 * i + j, i, rng.choice(known), rng.choice([20, 21, 22, 24, 27, None]), rng.choice([1, 1, 2, None])) for i in range(150) for j in range(3)]
    accused = spark.createDataFrame(people, "accused_id long, case_id long, name string, age int, gender int")
    want = {tuple(r) for r in graph.resolve(cases, accused)[1].collect()}
    got = {tuple(r) for r in graph.merged_groups(cases, accused).collect()}
    assert got == want and len({c for _, c in want}) > 3


def test_pairs_within_groups_are_counted_not_formed(spark):
    n = 60_000  # 1.8 billion pairs
    rows = spark.range(n).select("id", F.lit("x").alias("g"))
    s = graph.group_scores(rows, rows.withColumn("g", F.col("id") % 2)).first()
    assert (s.tp, s.fp, s.fn) == (n // 2 * (n // 2 - 1), n * (n - 1) // 2 - n // 2 * (n // 2 - 1), 0)
    small = [(i, i % 4 if i % 5 else None) for i in range(40)], [(i, i % 3) for i in range(5, 50)]
    for more in ([], [(3, 1)]):  # an id of two groups
        f, t = spark.createDataFrame(small[0] + more, "id long, g long"), spark.createDataFrame(small[1], "id long, g long")
        assert graph.group_scores(f, t).first() == graph.pair_scores(graph.pairs_within(f, "id", "g"), graph.pairs_within(t, "id", "g")).first()


def test_names_that_begin_alike_are_looked_up_not_tried(spark):
    names = spark.range(3000).select(F.format_string("Customer#%06d", "id").alias("name")).union(spark.sql("SELECT 'Customer#0059' UNION ALL SELECT 'ab' UNION ALL SELECT NULL"))
    texts = spark.range(3000).select("id", F.format_string("Mr-Customer#%06d, ab", F.col("id") * 2).alias("told"))
    masked = governance.masked_table(texts, ["told"], names)
    assert "contains(" not in masked._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.id: r.told for r in masked.collect()}
    assert got[1] == got[1499] == "Mr-[NAME-MASKED], ab"
    assert got[2999] == "Mr-[NAME-MASKED]98, ab" and got[2000] == "Mr-Customer#004000, ab"


def test_term_weights_take_two_exchanges_of_postings(spark):
    docs = spark.createDataFrame([(1, "red fox red hen"), (2, "red hen"), (2, "blue"), (3, None), (4, "fox")], "id long, text string")
    vectors, terms = retrieval.tfidf(docs)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+L?, term", plan) and len(set(re.findall(r"Exchange hashpartitioning\((\w+)", plan))) == 2
    got = {(r.id, r.term): r.w for r in vectors.collect()}
    assert {r.term: r.df for r in terms.collect()} == {"red": 2, "fox": 2, "hen": 2, "blue": 1, "red fox": 1, "fox red": 1, "red hen": 2}
    assert abs(sum(w * w for (i, _), w in got.items() if i == 2) - 1) < 1e-9 and len(got) == 11
    assert abs(got[2, "blue"] / got[2, "red"] - (math.log(6 / 2) + 1) / (math.log(6 / 3) + 1)) < 1e-9


def test_wide_rows_of_scratch_tables_fall_into_small_row_groups(spark):
    scratch = Scratch(spark, "wide")
    wide = spark.range(0, 48, 1, 1).select("id", F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8_000)), lambda i: F.array(F.sha2(F.concat_ws("-", "id", i), 512)))).alias("a")).select("id", F.concat_ws("", "a").alias("body"))
    assert scratch.store(wide, "rows").count() == 48
    (file,) = glob.glob(f"{scratch.path('rows')}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 20 << 20 < sum(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups))


def test_near_pairs_are_not_sent_to_the_driver(spark):
    rows = spark.createDataFrame([(i, 12.9, 77.5, datetime.date(2024, 1, 1 + i % 28)) for i in range(50)], "id long, lat double, lon double, day date")
    pairs = stats.near_pairs(rows, rows, 400, 42)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 50 * 49


def test_near_repeat_stream_meets_by_place_and_period(spark):
    rows = spark.readStream.format("rate").load().select(F.col("value").alias("id"), F.lit(12.9).alias("lat"), F.lit(77.5).alias("lon"), F.col("timestamp").alias("ts"))
    plan = near_repeat_stream(rows, rows)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"Join Inner, .*t_a#\d+L? = t_b#\d+", plan)


def test_networks_are_counted_without_pairs_of_cases(spark):
    rng = random.Random(5)
    held = [(c, 100 * c + a, f"{k}:{rng.randrange(12)}") for c in range(60) for a in range(1 + c % 2) for k in ("Phone", "Vehicle") for _ in range(rng.randrange(3))]
    held += [(99, 9900, f"Phone:{i}") for i in range(12)]
    who = spark.createDataFrame(sorted({(c, a) for c in range(60) for a in range(100 * c, 100 * c + 1 + c % 2)} | {(99, 9900)}), "case_id long, accused_id long")
    edges = spark.createDataFrame([(f"Person:{a}", e) for _, a, e in held], "src string, dst string")
    some = who.select("case_id").distinct().where("case_id <> 3")
    want = graph.network_summary(graph.network(some, who, edges)).select("case_id", "accused", "evidence", "linked", F.aggregate("cases", F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))
    want = sorted(map(tuple, want.collect()))
    for most in (0, 2, 8):
        assert sorted(map(tuple, graph.network_counts(some, who, edges, most).collect())) == want
    # 20,000 cases of one phone are linked in 200 million ways
    many = spark.range(20_000).select(F.col("id").alias("case_id"), F.col("id").alias("accused_id"))
    one = graph.network_counts(many, many, many.select(F.concat(F.lit("Person:"), F.col("accused_id").cast("string")).alias("src"), F.lit("Phone:1").alias("dst")))
    assert one.agg(F.min("linked"), F.max("linked")).first() == (19_999, 19_999)


def test_similar_behaviour_by_blocks_of_sets(spark):
    rng = random.Random(3)
    sets = {i: frozenset(rng.sample("abcdefghij", rng.randint(1, 7))) for i in range(120)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "case_id long, tag string")
    got = sorted((r.case_id, r.rank, r.peer, r.similarity) for r in analytics.similar_by_behaviour(rows, top=4, block=25).collect())
    want = []
    for a, s in sets.items():
        best = sorted((-math.floor(1e6 * len(s & o) / len(s | o) + 0.5) / 1e6, b) for b, o in sets.items() if a != b and 2 * len(s & o) >= len(s | o))[:4]
        want += [(a, i + 1, b, -j) for i, (j, b) in enumerate(best)]
    assert got == sorted(want)


def test_top_by_blocks_equals_the_join(spark):
    rng = random.Random(11)
    texts = [" ".join(["common", *(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(8)))]) for _ in range(500)]
    texts[40:60] = [texts[3]] * 20
    docs = spark.createDataFrame([(1000 - i, x) for i, x in enumerate(texts)], "id long, text string")
    vectors, terms = retrieval.tfidf(docs, bigrams=False)
    some = vectors.where("id % 7 = 0")
    for queries, block in ((vectors, 250), (some, 90)):
        want = sorted((r.query, r["rank"], r.id, r.score) for r in retrieval.top_cosine(queries, vectors, 4).collect())
        assert sorted((r.query, r["rank"], r.id, r.score) for r in retrieval.top_by_blocks(queries, vectors, 4, block=block).collect()) == want


def test_blocks_of_documents_hold_little_and_send_the_best_only():
    rng = np.random.default_rng(1)

    def block(lo, n=8192, m=20):
        raw = [np.repeat(np.arange(n), m).astype("<i4"), rng.integers(0, 5000, n * m).astype("<i8"), (rng.random(n * m) / m).astype("<f8")]
        return pa.table({"ids": pa.array([list(range(lo, lo + n))], pa.list_(pa.int64())), "packed": pa.array([b"".join(x.tobytes() for x in raw)], pa.binary())})

    left, right = block(0), block(10**6)
    tracemalloc.start()
    out = retrieval._best_of_blocks(6, 6)((0, 1), left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows <= 6 * 8192 and peak < 200e6


def test_jaccard_pairs_of_small_sets_form_few_candidates(spark):
    rng = random.Random(8)
    sets = {i: {f"i{rng.randrange(12)}" for _ in range(rng.randint(1, 9))} for i in range(90)} | {100 + i: {f"k{j}" for j in range(30) if j != i % 4} for i in range(8)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, item string").coalesce(1)
    for t in (0.34, 0.7):
        want = sorted((a, b) for a, s in sets.items() for b, o in sets.items() if a < b and len(s & o) / len(s | o) >= t)
        assert sorted((r.a, r.b) for r in retrieval.jaccard_pairs(rows, t).collect()) == want
    # 700 sets of 6 of 12 items: half of all pairs share an item of a prefix
    many = [(i, f"i{j}") for i, c in enumerate(itertools.islice(itertools.combinations(range(12), 6), 700)) for j in c]
    r = spark.createDataFrame(many, "rep long, item string").withColumns({"n": F.lit(6), "df": F.lit(1).cast("long")})
    keys = retrieval._prefix_keys(r, 0.7)
    met = keys.groupBy("key").agg(F.count("*").alias("c")).agg(F.sum(F.expr("c * (c - 1) div 2"))).first()[0]
    assert met < 700 * 699 // 4


def test_people_of_a_block_link_by_classes_as_by_pairs():
    from skein.functions import names
    from skein.streaming.resolver import met_classes

    rng = random.Random(5)
    for _ in range(300):
        pool = rng.sample(["Ann Lee", "Anne Lee", "An Lee", "Bob Ray", "..", "ರಮೇಶ್", "Ramesh"], 3)
        people = [(i, rng.choice([None, *range(4)]), rng.choice([*pool, None]), rng.choice([None, 30, 31, 32, 33]), rng.choice([None, 1])) for i in range(rng.randrange(2, 14))]
        order = rng.sample(people, len(people))
        cut, classes, links = rng.randrange(len(people)), {}, []
        for part in (order[:cut], order[cut:]):
            links += met_classes(classes, part)
        merged = [(a[0], b[0]) for a, b in itertools.combinations(people, 2) if (a[1] is None or b[1] is None or a[1] != b[1]) and a[4] == b[4] and None not in (a[3], b[3]) and abs(a[3] - b[3]) <= 2 and a[2] and b[2] and names.similarity_of(a[2], b[2]) >= graph.NAME_SIMILAR]

        def groups(edges):
            at = {p[0]: p[0] for p in people}
            for _ in people:
                for a, b in edges:
                    at[a] = at[b] = min(at[a], at[b])
            return at

        assert groups(links) == groups(merged)
    many = [(i, i, "Ann Lee", 30 + i % 2, 1) for i in range(2000)]
    assert len(met_classes({}, many)) < 2 * len(many)


def test_incremental_identities_form_no_pairs(spark, tmp_path):
    parts = ", ".join(f"({i}, '{'Ann Lee' if i % 2 else 'Anne Lee'}', 'Brand#{i % 2}', 'ECONOMY', 7, 900.0 + {i % 3})" for i in range(600))
    _same_as_sql(spark, "r03_incremental_identities", tmp_path, part=f"SELECT p_partkey::BIGINT AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice::DOUBLE AS p_retailprice FROM (VALUES {parts}) t(p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)")
    met = glob.glob(f"{_newest('resolver')}/er/meetings/**/*.parquet", recursive=True)
    assert 0 < sum(pq.ParquetFile(f).metadata.num_rows for f in met) < 3000


def test_near_groups_of_tiles_are_those_of_the_sweep(spark):
    rng = random.Random(3)
    day = datetime.date(2024, 1, 1)
    for east in (77.0, 179.7):
        rows = [(i, 12.9 + rng.random() * 0.6, (east + rng.random() * 0.6 + 180) % 360 - 180, day + datetime.timedelta(rng.randrange(90))) for i in range(1500)]
        df = spark.createDataFrame(rows, "id long, lat double, lon double, day date")
        near = {}
        for r in stats.near_pairs(df, df, 2000, 20).collect():
            near.setdefault(r.a_id, []).append(r.b_id)
        order = [r[0] for r in sorted(rows, key=lambda r: (-r[3].toordinal(), r[0]))]
        expected = sorted((g[0], x) for g in greedy.sweep(order, near, set(order), {}, 3, 0) for x in g)
        before = greedy._REACH
        for greedy._REACH in (2, before):  # many small tiles, and a few
            assert sorted(map(tuple, greedy.near_groups(df, 2000, 20, 3, most=400).collect())) == expected and expected
        greedy._REACH = before


def test_near_repeat_clusters_form_no_pairs(spark):
    c = spark.sql("SELECT id AS case_id, 12.9D AS lat, 77.5D + id / 1e9D AS lon, CAST('2024-01-01' AS DATE) AS registered, 'Burglary' AS crime FROM range(5000)")
    got = analytics.near_repeat_clusters(c).collect()
    assert [(r.cluster, r.size) for r in got] == [(0, 5000)]
    stored = glob.glob(f"{_newest('near-groups')}/**/*.parquet", recursive=True)
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in stored) <= 3 * 5000


def test_components_write_less_each_round(spark):
    rng = random.Random(4)
    ids = [-7, 2**63 - 1, -(2**63), *rng.sample(range(10**12), 3000)]
    path = list(zip(ids, ids[1:], strict=False))
    pairs = [p for i, p in enumerate(path) if i % 1500] + [(5, 5), (1, None)] + path[:40]
    pairs += [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    root = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in pairs:
        if None not in p and p[0] != p[1]:
            low, high = sorted(map(top, p))
            root[high] = low
    for small in (0, 20):
        got = components.connected_components(spark.createDataFrame(pairs, "a long, b long"), small=small)
        assert sorted(map(tuple, got.collect())) == sorted((x, top(x)) for x in root)
        # every round's moves are kept: each has a part of the vertices of the round before
        place = _newest("components")
        moves = [spark.read.parquet(f).count() for f in sorted(glob.glob(f"{place}/moves*"), key=lambda f: int(re.findall(r"\d+", f)[-1]))]
        assert len(moves) > 3 and sum(moves) < 3 * len(root)


def test_edges_are_merged_where_their_rows_are_dealt(spark):
    told = ["Phone +919000000001. Phone +919000000001. Paid to acct7@ybl.", "Vehicle KA-01-AB-0001.", None, "Phone +919000000001. Vehicle KA-01-AB-0001."]
    cases = spark.createDataFrame([(i, told[i % 4], i % 3 or None, "D" if i % 2 else None, "Theft", "F", 1.0, 2.0, "2024-01-01") for i in [*range(8), 3]], "case_id long, facts string, station_id long, district string, crime string, status string, lat double, lon double, registered string")
    sections = spark.createDataFrame([(1, "a", None), (1, None, "a"), (2, "a", "b"), (2, "a", "b")], "case_id long, act string, section string")
    for again in (0, 1):  # an accused of two cases
        people = [(10 + i, i, "Ann", 30, 1) for i in range(8)] + [(10, 3, "Ann", 30, 1), (None, 1, "", 1, 1)][: 2 * again]
        edges = graph.build_graph(cases, spark.createDataFrame(people, "accused_id long, case_id long, name string, age int, gender int"), None, None, sections)[1]
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(src" not in plan and not re.search(r"hashpartitioning\(\w+#\d+L?, (dst|type|value)", plan)
        got = {(r.src, r.dst, r.rel): (r.source_case_id, r.source_span, r.span_start) for r in edges.collect()}
        assert len(got) == edges.count()
        want = {("FIR:1", "Section:a", "CHARGED_UNDER"): (1, None, None), ("FIR:2", "Section:a-b", "CHARGED_UNDER"): (2, None, None)}
        for i in range(8):
            want |= {(f"FIR:{i}", f"Location:{i}", "OCCURRED_AT"): (i, None, None)}
            if i % 3:
                want |= {(f"FIR:{i}", f"Station:{i % 3}", "REGISTERED_AT"): (i, None, None)}
                if i % 2:
                    want |= {(f"Station:{i % 3}", "District:D", "IN_DISTRICT"): (i, None, None)}
        for a, c, *_ in sorted(people, key=lambda p: p[1]):
            who = "Person" if a is None else f"Person:{a}"
            want[who, f"FIR:{c}", "ACCUSED_IN"] = (c, None, None)
        for a, c in [(None, i) for i in range(8)] + sorted(((p[0], p[1]) for p in people), key=lambda p: p[1]):
            for m in re.finditer(r"\+91\d+|KA\S+\d|acct7@ybl", told[c % 4] or ""):
                kind = {"+": "Phone", "K": "Vehicle", "a": "FinancialAccount"}[m[0][0]]
                want[f"FIR:{c}", f"{kind}:{m[0]}", {"Phone": "USED_PHONE", "Vehicle": "VEHICLE_SEEN"}.get(kind, "TRANSACTED_VIA")] = (c, m[0], m.start())
                if (a, c) in {p[:2] for p in people} and kind != "FinancialAccount":
                    want["Person" if a is None else f"Person:{a}", f"{kind}:{m[0]}", {"Phone": "PERSON_USED_PHONE"}.get(kind, "OWNS_VEHICLE")] = (c, m[0], m.start())
        assert got == want


def test_behaviour_clusters_hold_every_case(spark):
    rng = random.Random(6)
    pool = ["entry:a", "entry:b", "tool:a", "approach:a", "target:a", "property:a", "time:a", "time:b"]
    cases = {i: frozenset(rng.sample(pool, rng.randint(2, 6))) for i in rng.sample(range(5000), 300)}
    cases |= {6000 + i: frozenset(pool[:4]) for i in range(40)}
    rows = spark.createDataFrame([(i, [*s, min(s)]) for i, s in cases.items()], "case_id long, tags array<string>")
    wide = sorted(i for i, s in cases.items() if len(s) >= 3)
    for least, similar, shown in ((3, 0.7, 1), (12, 0.55, 2)):
        near = {i: [j for j in wide if j != i and len(cases[i] & cases[j]) / len(cases[i] | cases[j]) >= similar] for i in wide}
        how = {i: frozenset(x for x in cases[i] if x[:4] in ("entr", "tool", "appr")) for i in wide}
        want = sorted((min(g), i, ",".join(sorted(frozenset.intersection(*(cases[x] for x in g))))) for g in greedy.sweep(wide, near, set(wide), how, least, 2) for i in g)
        assert sorted(map(tuple, analytics.behaviour_clusters(rows, similar, least, shown=shown).collect())) == want and want


def test_behaviour_clusters_of_the_query_hold_copies_of_one_district(spark):
    from skein.functions import text as T
    from skein.plans import derived
    from skein.plans.registry import Tables

    t = "/root/testdata/sf0.001"
    c = derived.corpus(Tables(spark, t))["cases"]
    told = {r.case_id: set(r.t) | {r.d} for r in c.select("case_id", T.lexicon_tags(F.col("facts")).alias("t"), T.time_of_day(F.col("occurred")).alias("d")).collect()}
    wide = sorted(i for i, s in told.items() if len(s) >= 3)
    near = {i: [j for j in wide if j != i and len(told[i] & told[j]) / len(told[i] | told[j]) >= 0.7] for i in wide}
    how = {i: frozenset(x for x in told[i] if x.startswith(("entry:", "tool:", "approach:"))) for i in wide}
    want = sorted((min(g), i) for g in greedy.sweep(wide, near, set(wide), how, 3, 2) for i in g)
    assert sorted((r.cluster, r.case_id) for r in __spark_entry__.queries()["g14_behaviour_clusters"](spark, t).collect()) == want and want


def _newest(name):
    from skein.session import _ROOTS

    return next(root for _, root in reversed(_ROOTS) if f"/{name}-" in root)
