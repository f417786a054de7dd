"""Evidence graph and entity resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skein.functions import names, stats, text as T
from skein.operators.components import connected_components
from skein.session import Scratch

# The labels and relations that a graph may have.
LABELS = ["FIR", "Person", "Location", "PoliceStation", "District", "Section", "Victim", "Complainant", "Phone", "Vehicle", "FinancialAccount"]
RELATIONS = ["ACCUSED_IN", "VICTIM_IN", "COMPLAINANT_IN", "REGISTERED_AT", "OCCURRED_AT", "CHARGED_UNDER", "IN_DISTRICT", "USED_PHONE", "PERSON_USED_PHONE", "VEHICLE_SEEN", "OWNS_VEHICLE", "TRANSACTED_VIA", "CO_ACCUSED_WITH", "SAME_MO_AS"]
NODE_OF = {"phone": "Phone", "vehicle": "Vehicle", "upi": "FinancialAccount"}
#: Thresholds of the pair decision.
NAME_SIMILAR, NAME_WEAK, AGE_TOLERANCE, BLOCK_CAP = 0.80, 0.70, 2, 60
#: Cases of a part whose edges one task holds.
DEALT = 50_000


def checked(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Raises at run time where a value is outside the vocabulary."""
    return df.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column)))))


def mentions(cases: DataFrame) -> DataFrame:
    """(case_id, type, value, span, start, end)."""
    return cases.select("case_id", F.explode(T.mention_spans("facts")).alias("m")).select("case_id", "m.*")


def evidence(cases: DataFrame) -> DataFrame:
    """(case_id, entity) without offsets, all by built-in functions."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in NODE_OF.items() for x in kv)), F.col("m.type"))
    return cases.select("case_id", F.explode(T.mention_values(F.col("facts"))).alias("m")).select("case_id", F.concat_ws(":", kind, F.col("m.value")).alias("entity")).distinct()


def build_graph(cases: DataFrame, accused: DataFrame, complainants: DataFrame | None = None, victims: DataFrame | None = None, sections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, label, props), edges (src, dst, rel, source_case_id, source_span, span_start, span_end)).

    An accused row is a person of its own; every accused of a case gets the case's phones and vehicles, but no accounts.
    victims (victim_id, case_id, name), sections (case_id, act, section). A repeated edge keeps its last span.
    Rows are dealt by the id that their edges start from, `DEALT` cases to a part, before edges are made of them, so a task
    holds the edges of its part, however large the tables' files are. Mentions are found once and written.
    """
    scratch = Scratch(cases.sparkSession, "graph")
    parts = max(int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cases.count() // DEALT))
    fir, person, place = T.node_id("FIR", F.col("case_id")), T.node_id("Person", F.col("accused_id")), T.node_id("Location", F.col("case_id"))
    station, district = T.node_id("Station", F.col("station_id")), T.node_id("District", F.col("district"))

    def nodes_of(df: DataFrame, node: Column, label: str, props: list[str]) -> DataFrame:
        pairs = [x for p in props for x in (F.lit(p), F.col(p).cast("string"))]
        return df.select(node.alias("id"), F.lit(label).alias("label"), F.create_map(*pairs).cast("map<string,string>").alias("props")).dropDuplicates(["id"])

    # by case, so that what is found in one case is merged where it is found
    said = cases.select("case_id", "facts").repartition(parts, "case_id").select("case_id", T.mention_spans_once("facts").alias("m"))
    said = said.repartition(parts, "case_id").select("case_id", F.explode("m").alias("m")).select("case_id", "m.*").groupBy("case_id", "type", "value")
    said = scratch.store(said.agg(F.max_by(F.struct("span", "start", "end"), "start").alias("m")).select("case_id", "type", "value", "m.*"), "said")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in NODE_OF.items() for x in kv)), F.col("type"))
    entity = F.concat_ws(":", kind, "value")
    nodes = [
        nodes_of(cases, fir, "FIR", ["case_id", "crime", "district", "registered", "status"]),
        nodes_of(cases, place, "Location", ["case_id", "lat", "lon"]),
        nodes_of(cases.where("station_id is not null").select("station_id", "district").distinct(), station, "PoliceStation", ["station_id", "district"]),
        nodes_of(cases.where("district is not null").select("district").distinct(), district, "District", ["district"]),
        nodes_of(accused, person, "Person", ["accused_id", "name", "age", "gender", "case_id"]),
        said.select(entity.alias("id"), kind.alias("label"), F.create_map(F.lit("value"), F.col("value")).alias("props")).dropDuplicates(["id"]),
    ]

    def edges_of(df: DataFrame, src: Column, dst: Column, rel: Column | str) -> DataFrame:
        cite = [F.col(c).alias(a) if c in df.columns else F.lit(None).cast(t).alias(a) for c, a, t in (("span", "source_span", "string"), ("start", "span_start", "int"), ("end", "span_end", "int"))]
        return df.select(src.alias("src"), dst.alias("dst"), (F.lit(rel) if isinstance(rel, str) else rel).alias("rel"), F.col("case_id").alias("source_case_id"), *cite)

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        """Rows without repeated ones, dealt by the first key."""
        return df.select(*keys).repartition(parts, keys[0]).distinct()

    # pairs of station and district repeat in all their cases, so these are merged where they are read
    homes = cases.where("station_id is not null and district is not null").groupBy("station_id", "district").agg(F.max("case_id").alias("case_id"))
    by_type = F.when(F.col("type") == "phone", "USED_PHONE").when(F.col("type") == "vehicle", "VEHICLE_SEEN").otherwise("TRANSACTED_VIA")
    owned = accused.select("case_id", "accused_id").repartition(parts, "case_id").join(said.where("type <> 'upi'").repartition(parts, "case_id"), "case_id")
    last = F.max_by(F.struct("case_id", "span", "start", "end"), F.struct("case_id", "start")).alias("e")
    if not accused.groupBy("accused_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        owned = owned.repartition(parts, "accused_id").groupBy("accused_id", "type", "value").agg(last).select("accused_id", "type", "value", "e.*")
    edges = [
        edges_of(dealt(cases, "case_id"), fir, place, "OCCURRED_AT"),
        edges_of(dealt(cases.where("station_id is not null"), "case_id", "station_id"), fir, station, "REGISTERED_AT"),
        edges_of(homes, station, district, "IN_DISTRICT"),
        edges_of(dealt(accused, "accused_id", "case_id"), person, fir, "ACCUSED_IN"),
        edges_of(said, fir, entity, by_type),
        edges_of(owned, person, entity, F.when(F.col("type") == "phone", "PERSON_USED_PHONE").otherwise("OWNS_VEHICLE")),
    ]
    if victims is not None:
        node = T.node_id("Victim", F.col("victim_id"))
        nodes.append(nodes_of(victims, node, "Victim", ["victim_id", "name"]))
        edges.append(edges_of(dealt(victims, "victim_id", "case_id"), node, fir, "VICTIM_IN"))
    if complainants is not None:
        node = T.node_id("Complainant", F.col("complainant_id"))
        nodes.append(nodes_of(complainants, node, "Complainant", ["complainant_id", "name"]))
        edges.append(edges_of(dealt(complainants, "complainant_id", "case_id"), node, fir, "COMPLAINANT_IN"))
    if sections is not None:
        node = F.concat(F.lit("Section:"), F.concat_ws("-", "act", "section"))
        nodes.append(nodes_of(sections, node, "Section", ["act", "section"]))
        edges.append(edges_of(dealt(sections.withColumn("node", node), "case_id", "node"), fir, F.col("node"), "CHARGED_UNDER"))
    merged = reduce(DataFrame.unionByName, edges)
    return checked(reduce(DataFrame.unionByName, nodes), "label", LABELS), checked(merged, "rel", RELATIONS)


def find_nodes(nodes: DataFrame, label: str, **filters: object) -> DataFrame:
    """Nodes of a label whose properties equal the given values."""
    return nodes.where(reduce(Column.__and__, (F.col("props")[k] == str(v) for k, v in filters.items()), F.col("label") == label))


def of_cases(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table (accused, victims, complainants, arrests, sections) that belong to the given cases."""
    wanted = ids.select("case_id").distinct()
    return {name: rows.join(wanted, "case_id", "left_semi") for name, rows in tables.items()}


def network(cases: DataFrame, accused: DataFrame, edges: DataFrame) -> DataFrame:
    """For every case in `cases` the paths case -> accused -> evidence -> other case: (case_id, accused_id,
    evidence, other_case), with nulls where a path ends early.

    An accused's evidence are the phones, vehicles and accounts of its person's edges; another case is linked where
    one of its accused has the same evidence. Each person's distinct evidence is joined once with the cases behind it."""
    who = accused.select("case_id", "accused_id", T.node_id("Person", F.col("accused_id")).alias("person"))
    own = edges.where("dst like 'Phone:%' or dst like 'Vehicle:%' or dst like 'FinancialAccount:%'").select(F.col("src").alias("person"), F.col("dst").alias("evidence")).distinct()
    held = who.join(own, "person")
    behind = held.select("evidence", F.col("case_id").alias("other_case")).distinct()
    several = behind.groupBy("evidence").agg(F.count("*").alias("n")).where("n > 1").select("evidence")
    links = behind.join(several, "evidence", "left_semi")
    roots = who.join(cases.select("case_id").distinct(), "case_id", "left_semi").join(own, "person", "left")
    reached = roots.select("case_id", "accused_id", "evidence").join(links, "evidence", "left")
    mine = F.col("other_case") == F.col("case_id")
    return reached.select("case_id", "accused_id", "evidence", F.when(~mine, F.col("other_case")).alias("other_case")).distinct()


def network_summary(paths: DataFrame) -> DataFrame:
    """Q06: per case the number of its accused, evidence and linked cases, and these in order."""
    return paths.groupBy("case_id").agg(F.countDistinct("accused_id").alias("accused"), F.countDistinct("evidence").alias("evidence"), F.countDistinct("other_case").alias("linked"), F.array_sort(F.collect_set("other_case")).alias("cases"))


def network_counts(cases: DataFrame, accused: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """Q06: network_summary() without the lists: (case_id, accused, evidence, linked, checksum), checksum the sum of the linked ids.

    The cases behind a case's evidence are counted by inclusion and exclusion over the subsets of the evidence, so no case
    meets another one, however many share a phone. Cases with more than `most` pieces of evidence have too many
    subsets; they, and others where linked to them, are met one by one."""
    scratch = Scratch(edges.sparkSession, "network")
    who = accused.select("case_id", "accused_id", T.node_id("Person", F.col("accused_id")).alias("person"))
    own = edges.where("dst like 'Phone:%' or dst like 'Vehicle:%' or dst like 'FinancialAccount:%'").select(F.col("src").alias("person"), F.col("dst").alias("evidence")).distinct()
    held = who.join(own, "person").groupBy("case_id").agg(F.array_sort(F.collect_set("evidence")).alias("held"))
    held = scratch.store(held.withColumn("few", F.size("held") <= most), "held")
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("held")) - 1).cast("int"))
    few = held.where("few").select("case_id", "held", F.explode(masks).alias("mask"))
    # subsets are told apart by 64 bits, as texts are elsewhere
    few = few.select("case_id", F.filter("held", lambda e, i: F.bit_get(F.col("mask"), i) == 1).alias("subset")).select("case_id", F.xxhash64("subset").alias("subset"), (2 * F.pmod(F.size("subset"), F.lit(2)) - 1).alias("sign"))
    roots = who.join(cases.select("case_id").distinct(), "case_id", "left_semi").groupBy("case_id").agg(F.countDistinct("accused_id").alias("accused"))
    of = few.groupBy("subset").agg(F.count("*").alias("n"), F.sum("case_id").alias("s"))
    counted = few.join(of, "subset").groupBy("case_id").agg((F.sum(F.col("sign") * F.col("n")) - 1).alias("n"), (F.sum(F.col("sign") * F.col("s")) - F.col("case_id")).alias("s"))
    each = held.select("case_id", "few", F.explode("held").alias("e"))
    side = each.select("e", F.col("case_id").alias("other"), F.col("few").alias("other_few"))
    big = each.where("not few").join(side, "e").where("case_id <> other").select("case_id", "other", "other_few")
    met = big.select("case_id", "other").union(big.where("other_few").select("other", "case_id")).distinct()
    met = met.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("other").alias("s"))
    total = counted.union(met).groupBy("case_id").agg(F.sum("n").alias("linked"), F.sum("s").alias("checksum"))
    none = F.lit(0).cast("long")
    out = roots.join(held.select("case_id", F.size("held").cast("long").alias("evidence")), "case_id", "left").join(total, "case_id", "left")
    return out.select("case_id", "accused", *(F.coalesce(c, none).alias(c) for c in ("evidence", "linked", "checksum")))


def neighbours(edges: DataFrame, ids: DataFrame, rel: str | None = None) -> DataFrame:
    """(id, neighbour, rel, direction) of the given ids."""
    e = edges.where(F.col("rel") == rel) if rel else edges
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "rel", F.lit("out").alias("direction")).union(e.select("dst", "src", "rel", F.lit("in")))
    return both.join(ids.select("id").distinct(), "id", "left_semi")


def shared_pairs(rows: DataFrame, owner: str, entity: str) -> DataFrame:
    """(a, b, shared): owners a < b with at least one entity in common, and which."""
    r = rows.select(F.col(owner).alias("o"), F.col(entity).alias("e")).distinct()
    # an entity of one owner makes no pair, and stays out of the join
    r = r.join(r.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").select("e"), "e", "left_semi")
    a, b = r.select("e", F.col("o").alias("a")), r.select("e", F.col("o").alias("b"))
    return a.join(b, "e").where("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_set("e")).alias("shared"))


def block_pairs(people: DataFrame, keys: Column, cap: int = BLOCK_CAP) -> DataFrame:
    """(a, b) with a blocking key in common; keys is an array column. Larger blocks than cap are left out."""
    k = people.select(F.col("id"), F.explode(F.array_distinct(keys)).alias("key")).distinct()
    k = k.join(k.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).select("key"), "key", "left_semi")
    return k.select("key", F.col("id").alias("a")).join(k.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct()


def person_keys(name: str = "name", age: str = "age", gender: str = "gender") -> Column:
    """(Soundex, gender, age bucket) keys of a person; needs `forms`, the name's Roman spellings."""
    sounds, buckets = names.phonetic_keys(F.col("forms")), stats.age_buckets(F.col(age))
    return F.flatten(F.transform(sounds, lambda s: F.transform(buckets, lambda b: F.concat_ws("|", s, F.col(gender).cast("string"), b))))


def decide(pairs: DataFrame) -> DataFrame:
    """Verdict, rule and confidence of pairs with case_a, case_b, name_sim, age_a, age_b, gender_a,
    gender_b and shared. Names propose; only shared evidence merges."""
    age_ok = F.coalesce(F.abs(F.col("age_a") - F.col("age_b")) <= AGE_TOLERANCE, F.lit(False))
    gender_ok = F.col("gender_a").eqNullSafe(F.col("gender_b"))
    close, shared = F.col("name_sim") >= NAME_SIMILAR, F.size("shared") > 0
    rule = (
        F.when(F.col("case_a") == F.col("case_b"), "same-case")
        .when(shared & close & gender_ok & age_ok, "A")
        .when(shared & (~close | ~age_ok), "C")
        .when(close & age_ok & gender_ok, "D")
        .when(F.col("name_sim") >= NAME_WEAK, "D-weak")
        .otherwise("none")
    )
    out = pairs.withColumns({"age_ok": age_ok, "gender_ok": gender_ok}).withColumn("rule", rule)
    verdict = F.when(F.col("rule") == "A", "merge").when(F.col("rule") == "C", "relate").when(F.col("rule").isin("D", "D-weak"), "review").otherwise("no")
    confidence = F.when(F.col("rule") == "A", F.least(F.lit(1.0), 0.6 + 0.4 * F.col("name_sim"))).when(F.col("rule") == "C", 0.5).when(F.col("rule") == "same-case", 0.0).otherwise(F.col("name_sim"))
    return out.withColumns({"verdict": verdict, "confidence": confidence})


def candidate_decisions(people: DataFrame, entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with both people's fields, their shared entities and the decision.

    people (id, case_id, name, age, gender), entities (id, entity).
    """
    shared = shared_pairs(entities, "id", "entity")
    p = pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
    for side in "ab":
        p = p.join(people.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("case_id", "name", "age", "gender"))), side)
    return scored(p.withColumnsRenamed({"case_id_a": "case_a", "case_id_b": "case_b"}))


def scored(p: DataFrame) -> DataFrame:
    """decide() of pairs that have all but name_sim (name_a, name_b); similarity is taken once for each distinct pair of names."""
    sims = p.select("name_a", "name_b").distinct().withColumn("name_sim", names.name_similarity("name_a", "name_b"))
    p = p.join(sims, p.name_a.eqNullSafe(sims.name_a) & p.name_b.eqNullSafe(sims.name_b)).drop(sims.name_a).drop(sims.name_b)
    return decide(p.withColumn("name_sim", F.coalesce("name_sim", F.lit(0.0))))


def resolve(cases: DataFrame, accused: DataFrame, cap: int = BLOCK_CAP, accounts_corroborate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(decisions, groups (id, component)). By default accounts do not count as a person's evidence."""
    own = evidence(cases)
    own = own if accounts_corroborate else own.where(~F.col("entity").startswith("FinancialAccount:"))
    people = accused.select(F.col("accused_id").alias("id"), "case_id", "name", "age", "gender")
    entities = people.join(own, "case_id").select("id", "entity")
    forms = people.select("name").distinct().withColumn("forms", names.romanised("name"))
    named = block_pairs(people.join(forms, "name"), person_keys(), cap)
    pairs = named.union(shared_pairs(entities, "id", "entity").select("a", "b")).distinct()
    decisions = candidate_decisions(people, entities, pairs)
    return decisions, connected_components(decisions.where("verdict = 'merge'"))


def merged_groups(cases: DataFrame, accused: DataFrame, accounts_corroborate: bool = False) -> DataFrame:
    """resolve()'s groups (id, component) alone. Only rule A merges, and it needs shared evidence, so names are not blocked and no
    decisions are made.

    People with the same evidence, name, age and gender are one class. Any two of a class in different cases merge, so a class with
    several cases hangs together by a star; classes are compared in pairs, by the people of an evidence key whose age and gender fit."""
    scratch = Scratch(cases.sparkSession, "merged")
    own = evidence(cases)
    own = own if accounts_corroborate else own.where(~F.col("entity").startswith("FinancialAccount:"))
    people = accused.select(F.col("accused_id").cast("long").alias("id"), "case_id", "name", "age", "gender").where("name is not null and age is not null")
    # the key of evidence is hashed: two keys meet with a probability of 2**-64, as elsewhere
    blank = scratch.store(people.select("name").distinct().where(names.name_similarity("name", "name") < NAME_SIMILAR), "blank")
    if not blank.isEmpty():  # a name without letters is not even like itself
        people = people.join(blank, "name", "left_anti")
    held = people.join(own.select("case_id", F.xxhash64("entity").alias("e")), "case_id").repartition("e")
    # of a class: the first person, its case, one person of another case, if any, and the people of the first case
    c = held.groupBy("e", "name", "age", "gender").agg(F.min(F.struct("id", "case_id")).alias("x"), F.collect_set(F.struct("id", "case_id")).alias("all"))
    c = c.select("e", "name", "age", "gender", F.col("x.id").alias("rep"), F.col("x.case_id").alias("case_id"), "all", F.filter("all", lambda m: m.case_id != F.col("x.case_id")).alias("others"))
    c = c.withColumn("mine", F.filter("all", lambda m: m.case_id == F.col("case_id"))).withColumn("n", F.count("*").over(W.partitionBy("e")))
    c = scratch.store(c.where("n > 1 or size(others) > 0").select("e", "name", "age", "gender", "rep", "case_id", "mine", "others", F.size("others").alias("_o"), "n"), "classes")
    star = c.where("_o > 0").select("rep", F.explode("others.id").alias("id")).union(c.where("_o > 0").select(F.array_min("others.id"), F.explode("mine.id")))
    # a class of one case does not hang together: its people are linked one by one
    one = F.when(F.col("_o") == 0, F.col("mine.id")).otherwise(F.array("rep"))
    side = c.where("n > 1").select("e", "name", "age", "gender", "case_id", (F.col("_o") > 0).alias("several"), one.alias("ids"))
    x, y = (side.select("e", *(F.col(f).alias(f"{f}_{p}") for f in ("name", "age", "gender", "case_id", "several", "ids"))) for p in "ab")
    before = F.struct("name_a", "age_a", F.array_min("ids_a")) < F.struct("name_b", "age_b", F.array_min("ids_b"))
    met = x.join(y, "e").where(before & F.col("gender_a").eqNullSafe(F.col("gender_b")) & (F.abs(F.col("age_a") - F.col("age_b")) <= AGE_TOLERANCE))
    met = met.where(F.col("several_a") | F.col("several_b") | (F.col("case_id_a") != F.col("case_id_b")))
    ends = met.select("name_a", "name_b", "ids_a", "ids_b").distinct()
    ends = scratch.store(ends, "met")
    sims = ends.select("name_a", "name_b").distinct().withColumn("name_sim", names.name_similarity("name_a", "name_b")).where(F.col("name_sim") >= NAME_SIMILAR)
    close = ends.join(sims.select("name_a", "name_b"), ["name_a", "name_b"]).select(F.explode("ids_a").alias("a"), "ids_b").select("a", F.explode("ids_b").alias("b"))
    return connected_components(star.toDF("a", "b").union(close))


def pair_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Tp, fp, fn, precision, recall, f1 of pair sets (a, b)."""
    f, t = found.select("a", "b").distinct(), truth.select("a", "b").distinct()
    both = f.withColumn("f", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["a", "b"], "full")
    s = both.agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return _ratios(s)


def group_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """pair_scores() of the pairs within groups, from rows (id, g) of both sides. Pairs are counted by group, not formed, as
    long as an id has one group a side."""
    scratch = Scratch(found.sparkSession, "scores")
    f, t = (x.where("id is not null and g is not null").select("id", F.col("g").alias(c)).distinct() for x, c in ((found, "f"), (truth, "t")))
    both = scratch.store(f.join(t, "id", "full"), "both")
    if not both.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return pair_scores(pairs_within(found, "id", "g"), pairs_within(truth, "id", "g"))

    def pairs(name: str, *by: str) -> DataFrame:
        n = both.dropna(subset=list(by)).groupBy(*by).agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0).cast("long")).alias(name))

    s = pairs("tp", "f", "t").crossJoin(F.broadcast(pairs("found", "f"))).crossJoin(F.broadcast(pairs("truth", "t")))  # one row each
    return _ratios(s.select("tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn")))


def _ratios(s: DataFrame) -> DataFrame:
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    s = s.withColumns({"precision": p, "recall": r})
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def pairs_within(groups: DataFrame, member: str, group: str) -> DataFrame:
    g = groups.select(F.col(group).alias("g"), F.col(member).alias("m"))
    return g.withColumnRenamed("m", "a").join(g.withColumnRenamed("m", "b"), "g").where("a < b").select("a", "b").distinct()


def same_name_pairs(people: DataFrame, name: str = "name") -> DataFrame:
    """Names with n rows and their n * (n - 1) / 2 pairs, without forming the pairs."""
    return people.groupBy(F.lower(F.trim(name)).alias("name")).agg(F.count("*").alias("n")).select("name", "n", F.expr("n * (n - 1) div 2").alias("pairs"))


#: The thresholds of the sweep.
SWEEP = [0.80, 0.85, 0.88, 0.90, 0.92, 0.95]


def name_edges(people: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(names (id, name), edges (a, b, s)): distinct names of rows (id, name), each by the smallest id that has it, and the
    pairs of them with equal Soundex of the first token and a Jaro-Winkler similarity of `least` or more."""
    names_ = people.where("name is not null").groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("id").alias("id"))
    first = F.element_at(F.split("name", r"\s+"), 1)
    p = names_.select("id", "name", F.soundex(F.regexp_replace(first, "[^a-z]", "")).alias("key"))
    both = p.select("key", F.col("id").alias("a"), F.col("name").alias("x")).join(p.select("key", F.col("id").alias("b"), F.col("name").alias("y")), "key").where("a < b")
    return names_, both.withColumn("s", names.jaro_winkler("x", "y")).where(F.col("s") >= least).select("a", "b", "s")


def strongest_forest(edges: DataFrame) -> DataFrame:
    """The spanning forest of largest similarity of edges (a, b, s), by Boruvka's rounds: every component takes its strongest
    edge to another one (ties to the smaller ends), and of the edges between two components only the strongest goes on.
    At any threshold, the forest's edges from there on have the components of all edges from there on."""
    scratch = Scratch(edges.sparkSession, "forest")
    e = scratch.store(edges.where("a <> b").select("a", "b", "s", F.col("a").alias("x"), F.col("b").alias("y")), "e0")
    taken, i = [], 0
    key = F.struct(F.col("s"), -F.least("a", "b"), -F.greatest("a", "b"), F.col("a"), F.col("b"), F.col("x"), F.col("y"))
    while not e.isEmpty():
        best = e.select(F.col("x").alias("c"), key.alias("k")).union(e.select(F.col("y").alias("c"), key.alias("k"))).groupBy("c").agg(F.max("k").alias("k"))
        best = scratch.store(best.select("k.s", "k.a", "k.b", "k.x", "k.y").distinct(), f"best{i}")
        taken.append(best.select("a", "b", "s"))
        comp = scratch.store(connected_components(best, "x", "y"), f"comp{i}")
        cx, cy = comp.select(F.col("id").alias("x"), F.col("component").alias("cx")), comp.select(F.col("id").alias("y"), F.col("component").alias("cy"))
        moved = e.join(cx, "x").join(cy, "y").where("cx <> cy").select("a", "b", "s", F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y"))
        i += 1
        e = scratch.store(moved.groupBy("x", "y").agg(F.max(F.struct(F.col("s"), -F.least("a", "b"), -F.greatest("a", "b"), F.col("a"), F.col("b"))).alias("k")).select("k.a", "k.b", "k.s", "x", "y"), f"e{i}")
        scratch.drop(f"e{i - 1}")
    empty = edges.sparkSession.createDataFrame([], "a long, b long, s double")
    return reduce(DataFrame.union, taken, empty).distinct()


def components_by_threshold(forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, id, component) of the forest's vertices with an edge from the threshold on; all thresholds in one run."""
    n = len(thresholds)
    levels = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(thresholds)))
    e = forest.select("a", "b", "s", F.explode(levels).alias("l")).where(F.col("s") >= F.col("l.t"))
    comp = connected_components(e.select((F.col("a") * n + F.col("l.i")).alias("a"), (F.col("b") * n + F.col("l.i")).alias("b")))
    at = F.element_at(F.array(*map(F.lit, thresholds)), (F.pmod("id", F.lit(n)) + 1).cast("int"))
    return comp.select(at.alias("threshold"), F.floor(F.col("id") / n).alias("id"), F.floor(F.col("component") / n).alias("component"))


def fuzzy_sweep(people: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) of grouping rows (id, name, true_person) by names alone: Soundex
    blocks, Jaro-Winkler, union-find. One forest answers all thresholds, and pairs are counted by class, not formed."""
    thresholds = thresholds or SWEEP
    scratch = Scratch(people.sparkSession, "sweep")
    named, edges = name_edges(people, min(thresholds))
    named, forest = scratch.store(named, "names"), scratch.store(strongest_forest(scratch.store(edges, "edges")), "forest")
    comp = scratch.store(components_by_threshold(forest, thresholds), "components")
    counts = people.groupBy(F.lower(F.trim("name")).alias("name"), "true_person").agg(F.count("*").alias("n")).join(named, "name")
    every = counts.select("id", "true_person", "n", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).join(comp, ["threshold", "id"], "left").withColumn("c", F.coalesce("component", "id"))
    both = every.groupBy("threshold", "c", "true_person").agg(F.sum("n").alias("n"))
    tp = both.groupBy("threshold").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("tp"))
    found = both.groupBy("threshold", "c").agg(F.sum("n").alias("n")).groupBy("threshold").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("found"))
    truth = people.groupBy("true_person").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0).cast("long")).alias("truth"))
    s = tp.join(found, "threshold").crossJoin(F.broadcast(truth))  # one row
    return _ratios(s.select("threshold", "tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn")))


def degree(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, degree): neighbours of a group's persons, over all relations."""
    both = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where(F.col("node").startswith("Person"))
    people = groups.select(T.node_id("Person", F.col("id")).alias("node"), "component")
    return both.join(people, "node").groupBy("component").agg(F.count("*").alias("degree"))


def identity_history(accused: DataFrame, groups: DataFrame) -> DataFrame:
    """For every accused its identity and all its cases; who is unresolved has the one case."""
    g = accused.join(groups.withColumnRenamed("id", "accused_id"), "accused_id", "left").withColumn("identity", F.coalesce("component", "accused_id"))
    cases = g.groupBy("identity").agg(F.array_sort(F.collect_set("case_id")).alias("cases"))
    return g.select("accused_id", "identity", F.col("component").isNotNull().alias("resolved")).join(cases, "identity")


def linked_cases(own: DataFrame) -> DataFrame:
    """(case_id, linked, entities) by phones and vehicles, in both directions."""
    s = shared_pairs(own.where("entity like 'Phone:%' or entity like 'Vehicle:%'"), "case_id", "entity")
    return s.select(F.col("a").alias("case_id"), F.col("b").alias("linked"), "shared").union(s.select("b", "a", "shared"))


def reasoning_graph(accused: DataFrame, own: DataFrame, groups: DataFrame) -> DataFrame:
    """Per identity its evidence, corroborated where at least two members' cases have it."""
    members = groups.withColumnRenamed("id", "accused_id").join(accused.select("accused_id", "case_id"), "accused_id")
    e = members.join(own, "case_id").groupBy("component", "entity").agg(F.countDistinct("accused_id").alias("members"), F.array_sort(F.collect_set("case_id")).alias("cases"))
    return e.withColumn("corroborated", F.col("members") >= 2)


def refused_pairs(decisions: DataFrame, limit: int = 6) -> DataFrame:
    """Pairs with all but equal names and no shared evidence; one for each left person, then the best."""
    r = decisions.where((F.col("name_sim") >= 0.95) & (F.size("shared") == 0))
    one = r.withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy(F.desc("name_sim"), "b"))).where("_n = 1").drop("_n")
    return one.orderBy(F.desc("name_sim"), "a", "b").limit(min(limit, 50))
