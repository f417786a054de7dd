"""Streams against the batch operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import stats
from skein.operators import graph
from skein.operators.components import connected_components
from skein.session import settings
from skein.sources import fixtures
from skein.streaming import near
from skein.streaming.resolver import IncrementalComponents, IncrementalResolver, block_rows

START = datetime.datetime(2026, 1, 1, 12)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of each micro-batch opens a state store of its own."""
    with settings(spark, {"spark.sql.shuffle.partitions": "2"}):
        yield


def ended(query, seconds=240):
    done = query.awaitTermination(seconds)
    query.stop()
    assert done, "the stream did not end"


def stream_of(spark, parts, schema, place):
    """Each part is a micro-batch."""
    for i, rows in enumerate(parts):
        df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("overwrite").parquet(f"{place}/{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(place))


@pytest.mark.parametrize("lat,lon", [(12.9, 77.5), (0.0, 179.9995), (60.0, -179.9995), (89.995, 10.0), (-45.0, 0.0)])
def test_near_pairs_at_edges_of_bands_and_of_the_map(spark, lat, lon):
    rng = random.Random(8)
    day = datetime.date(2025, 1, 1)
    spread = 0.01
    rows = [(i, max(-90.0, min(90.0, lat + spread * (rng.random() - 0.5))), (lon + spread * (rng.random() - 0.5) * (40 if lat > 89 else 1) + 180) % 360 - 180, day + datetime.timedelta(days=rng.randrange(90))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, day date")
    got = {(r.a_id, r.b_id) for r in stats.near_pairs(df, df, 400, 42).collect()}
    metres = stats.haversine_m(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
    every = df.alias("x").join(df.alias("y"), (F.col("x.id") != F.col("y.id")) & (metres <= 400) & (F.abs(F.datediff("x.day", "y.day")) <= 42))
    expected = {(r[0], r[1]) for r in every.select("x.id", "y.id").collect()}
    assert got == expected and expected


def test_near_repeat_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    # dense enough that most pairs lie across an edge of a cell
    rows = [(i, 12.995 + rng.random() * 0.012, 77.5 + rng.random() * 0.012, START + datetime.timedelta(days=i * 0.9, hours=rng.randrange(5))) for i in range(140)] + [(900, None, 77.5, START)]
    schema = "id long, lat double, lon double, ts timestamp"
    parts = [rows[i : i + 47] for i in range(0, len(rows), 47)]
    out = near.near_repeat_stream(stream_of(spark, parts, schema, tmp_path / "l"), stream_of(spark, parts, schema, tmp_path / "r"), 400, 42)
    ended(out.writeStream.format("memory").queryName("near").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    found = spark.table("near").collect()
    df = spark.createDataFrame(rows, schema).withColumn("day", F.to_date("ts"))
    expected = {(r.a_id, r.b_id) for r in stats.near_pairs(df, df, 400, 42).collect()}
    assert {(r.a, r.b) for r in found} == expected and len(found) == len(expected) > 300
    cells = {r.id: r.c for r in df.where("lat is not null").select("id", stats.place_cell(F.col("lat"), F.col("lon"), 400).alias("c")).collect()}
    assert sum(cells[a] != cells[b] for a, b in expected) > 100


def test_state_of_the_near_stream_ends_with_the_watermark(spark, tmp_path):
    rows = [(i, 12.9, 77.5 + i % 7, START + datetime.timedelta(days=30 * i)) for i in range(40)]
    schema = "id long, lat double, lon double, ts timestamp"
    parts = [rows[i : i + 5] for i in range(0, 40, 5)]
    out = near.near_repeat_stream(stream_of(spark, parts, schema, tmp_path / "l"), stream_of(spark, parts, schema, tmp_path / "r"), 400, 42)
    q = out.writeStream.format("memory").queryName("bounded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    kept = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]
    assert kept[-1] < sum(len(p) for p in parts)  # not all rows of both sides


def test_elevated_risk_expires(spark, tmp_path):
    at = lambda d: START + datetime.timedelta(days=d)
    schema = "area string, ts timestamp"
    parts = [[("x", at(0)), ("y", at(1)), (None, at(1))], [("x", at(30))], [("z", at(50))], [("z", at(51))], [("z", at(90))], [("z", at(91))]]
    out = near.elevated_risk(stream_of(spark, parts, schema, tmp_path / "in"), 42)
    ended(out.writeStream.format("memory").queryName("risk").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    got = {(r.area, r.status, r.last, r.n) for r in spark.table("risk").collect()}
    assert {("x", "ACTIVE", at(0), 1), ("x", "ACTIVE", at(30), 2), ("x", "EXPIRED", at(30), 2), ("y", "EXPIRED", at(1), 1)} <= got
    assert not any(a == "z" and s == "EXPIRED" for a, s, _, _ in got) and not any(a == "x" and s == "EXPIRED" and t == at(0) for a, s, t, _ in got)


@pytest.mark.parametrize("seed", [7, 11, 13])
def test_incremental_identities_equal_batch(spark, tmp_path, seed):
    c = fixtures.corpus(spark, 36, seed)
    own = graph.evidence(c["cases"]).where("entity not like 'FinancialAccount:%'").groupBy("case_id").agg(F.collect_set("entity").alias("entities"))
    people = c["accused"].join(own, "case_id", "left").select(F.col("accused_id").alias("id"), "case_id", "name", "age", "gender", "entities")
    people = people.union(people.where("id % 9 = 0"))  # some come twice
    schema = people.schema
    parts = [people.where(F.col("id") % 3 == k) for k in range(3)]
    resolver = IncrementalResolver(spark, str(tmp_path / "er"))
    ended(resolver.start(stream_of(spark, parts, schema, tmp_path / "in"), str(tmp_path / "c")))
    _, groups = graph.resolve(c["cases"], c["accused"])
    expected = sorted(map(tuple, groups.collect()))
    assert sorted(map(tuple, resolver.groups(spark).collect())) == expected and expected
    made = spark.read.parquet(str(tmp_path / "er/decisions"))
    # each pair has a person of its own batch, and reviews come from name blocks
    order = {r.id: r.id % 3 for r in people.select("id").distinct().collect()}
    assert made.where("verdict = 'review' and size(shared) = 0").count() > 0
    assert all(max(order[r.a], order[r.b]) >= 0 for r in made.collect())
    # the last batch comes again
    last = max(r.batch for r in made.select("batch").distinct().collect())
    again = spark.createDataFrame(made.where(F.col("batch") == last).where("verdict = 'merge'").select("a", "b").collect(), "a long, b long")
    resolver.components.add(again, last)
    assert sorted(map(tuple, resolver.groups(spark).collect())) == expected


def test_full_name_blocks_form_no_more_pairs(spark, tmp_path):
    schema = "id long, case_id long, name string, age int, gender int, entities array<string>"
    rows = [(i, i, "Ramesh Kumar", 40, 1, ["Phone:1"] if i % 10 == 0 else None) for i in range(40)]
    resolver = IncrementalResolver(spark, str(tmp_path / "er"), cap=9)
    ended(resolver.start(stream_of(spark, [rows[:7], rows[7:25], rows[25:]], schema, tmp_path / "in"), str(tmp_path / "c")))
    pairs = {(r.a, r.b) for r in spark.read.parquet(str(tmp_path / "er/decisions")).collect()}
    by_name = {(a, b) for a in range(10) for b in range(a + 1, 10)}
    by_phone = {(a, b) for a in range(0, 40, 10) for b in range(a + 10, 40, 10)}
    assert pairs == by_name | by_phone
    assert {r.component for r in resolver.groups(spark).collect()} == {0}
    assert block_rows(spark.createDataFrame([(None, 1, "x y", 3, 1, ["e"])], schema)).count() == 0


def test_incremental_components_follow_any_order_of_edges(spark, tmp_path):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    rng.shuffle(edges)
    comps = IncrementalComponents(spark, str(tmp_path / "cc"), buckets=8)
    for k in range(5):
        part = spark.createDataFrame(edges[k::5], "a long, b long")
        comps.add(part, k)
        if k in (1, 4):
            comps.add(part, k)
    got = {r.id: r.component for r in comps.groups(spark).collect()}
    expected = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: got[i] for i in expected} == expected and all(got[i] == i for i in got if i not in expected)


def test_one_audit_chain_over_batches(spark, tmp_path):
    from skein.streaming.audit import AuditLog

    rows = [(f"c{i % 3}" if i % 10 else None, i, f"p{i}") for i in range(60)]
    part = lambda k: spark.createDataFrame(rows[20 * k : 20 * k + 20], "chain string, seq long, payload string")
    log = AuditLog(spark, str(tmp_path / "log"), buckets=4)
    log(part(0), 0)
    for step in ("entries", "heads", "commit"):  # killed midway: nothing has changed
        with pytest.raises(InterruptedError):
            log(part(1), 1, fail=step)
        assert log.entries(spark).count() == 20
    log(part(1), 1)
    first = sorted(map(str, log.entries(spark).collect()))
    log(part(1), 1)  # comes again
    assert sorted(map(str, log.entries(spark).collect())) == first
    log(part(2), 2)
    kept = log.entries(spark)
    assert kept.count() == 60 and log.broken(spark).count() == 0
    by_hand = {}
    import hashlib

    for r in sorted(kept.collect(), key=lambda r: r.seq):
        prev = by_hand.get(r.chain, "GENESIS")
        assert r.prev_hash == prev
        by_hand[r.chain] = hashlib.sha256((prev + r.payload).encode()).hexdigest()
        assert r.entry_hash == by_hand[r.chain]
    assert {r.chain: r.head for r in log.heads(spark, 9).collect()} == by_hand
    # a changed entry, and a batch that is gone
    changed = kept.where("batch = 2").withColumn("payload", F.when(F.col("seq") == 43, "other").otherwise(F.col("payload"))).drop("batch").withColumn("bucket", F.lit(0))
    place = next(r.place for r in kept.collect() if r.seq == 43)
    rows_ = spark.createDataFrame(changed.collect(), changed.schema)
    rows_.write.mode("overwrite").parquet(str(tmp_path / "log/entries/batch=2"))
    chain = rows[43][0]
    assert [(r.chain, r.first_bad) for r in AuditLog.broken(log, spark).collect()] == [(chain, place)]


def test_audit_stream_survives_a_restart(spark, tmp_path):
    from skein.streaming.audit import AuditLog

    schema = "chain string, seq long, payload string"
    parts = [[("a", 10 * k + i, f"p{k}{i}") for i in range(5)] for k in range(4)]
    log = AuditLog(spark, str(tmp_path / "log"))

    def run():
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ended(source.writeStream.foreachBatch(log).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())

    stream_of(spark, parts[:2], schema, tmp_path / "in")
    run()
    for k in (2, 3):
        spark.createDataFrame(parts[k], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    run()
    kept = log.entries(spark).collect()
    assert [r.payload for r in sorted(kept, key=lambda r: r.place)] == [p for part in parts for _, _, p in part] and log.broken(spark).count() == 0


def test_sessions_are_evicted_in_the_order_they_began(spark, tmp_path):
    from skein.streaming.sessions import desk_sessions

    at = lambda m: START + datetime.timedelta(minutes=m)
    schema = "desk string, session string, turn long, case_id long, ts timestamp"
    parts = [
        [("d", "a", 1, 5, at(0)), ("d", "b", 1, 6, at(1)), ("d", "c", 1, 7, at(2)), ("d", "a", 2, None, at(3)), ("e", "a", 1, None, at(3))],
        [("d", "d", 1, None, at(10)), ("d", "a", 3, None, at(11)), ("d", "b", 2, None, at(12)), ("d", "c", 2, None, at(13))],  # d evicts a; a evicts b, b evicts c, c evicts d
        [("d", "c", 3, 9, at(20)), ("d", "c", 4, None, at(21)), ("d", "c", 5, None, at(22)), ("d", "c", 6, None, at(23)), (None, "x", 1, 3, at(24))],
        [("d", "c", 7, None, at(200))],  # idle
    ]

    def run(name):
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = desk_sessions(source, most=3, keep=4)
        ended(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start())

    stream_of(spark, parts[:2], schema, tmp_path / "in")
    run("one")
    for k in (2, 3):  # the stream is started again
        spark.createDataFrame(parts[k], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    run("two")
    got = {(r.desk, r.session, r.turn): (r.case_id, r.began) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {
        ("d", "a", 1): (5, True), ("d", "b", 1): (6, True), ("d", "c", 1): (7, True), ("d", "a", 2): (5, False), ("e", "a", 1): (None, True),
        ("d", "d", 1): (None, True), ("d", "a", 3): (None, True), ("d", "b", 2): (None, True), ("d", "c", 2): (None, True),
        ("d", "c", 3): (9, False), ("d", "c", 4): (9, False), ("d", "c", 5): (9, False), ("d", "c", 6): (None, True), ("", "x", 1): (3, True),
        ("d", "c", 7): (None, True),
    }
