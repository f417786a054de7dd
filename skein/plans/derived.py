"""An incident corpus derived from the star tables, with its SQL.

An order is a case: its customer is the station and the complainant, the customer's nation the district, its date and key
give time and place. The first two line numbers of an order are its accused: the part is the true person, with the
part's name, size as age, and type as gender. A person has three phones, of which a case shows one; large second
lines show a vehicle, returned lines an account. The narrative tells all of this, and is what evidence is read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.plans.registry import Tables
from skein.session import Scratch
from skein.sources.fixtures import STORIES

#: Market segments and the crimes they stand for; stories are told in the same order.
CRIMES = [("BUILDING", "House Burglary"), ("AUTOMOBILE", "Vehicle Theft"), ("MACHINERY", "Robbery"), ("FURNITURE", "Cheating"), ("HOUSEHOLD", "Assault")]


def _lines(t: Tables) -> DataFrame:
    first = t.lineitem.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"))
    return first.agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.max("l_quantity").alias("qty"), F.min("l_returnflag").alias("flag"))


def corpus(t: Tables) -> dict[str, DataFrame]:
    """cases, accused, truth (true_person, accused_id), arrests, complainants, victims, sections (rows may repeat), lines (case_id, line, part, supp) and
    planted (case_id, entity), the evidence that the narratives tell; written once."""
    scratch = Scratch(t.spark, "derived")
    k = F.col("o_orderkey")
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = scratch.store(_lines(t).join(c.select(k.alias("case_id")), "case_id", "left_semi"), "lines")
    said = [
        F.concat(F.lit("Phone +91"), (9_000_000_000 + F.col("part") * 3 + F.col("case_id") % 3).cast("string"), F.lit(".")),
        F.when((F.col("qty") > 40) & (F.col("line") == 2), F.concat(F.lit("Vehicle "), F.format_string("KA-%02d-AB-%04d", F.col("supp") % 70 + 1, F.col("part") % 10_000), F.lit("."))),
        F.when(F.col("flag") == "R", F.concat(F.lit("Paid to acct"), F.col("supp").cast("string"), F.lit("@ybl."))),
    ]
    told = lines.groupBy("case_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", F.array(*said).alias("said")))), lambda x: F.array_compact(x.said))), " ").alias("told"))
    crime, story = (F.coalesce(*(F.when(F.col("c_mktsegment") == s, v) for (s, _), v in zip(CRIMES, values, strict=True))) for values in ([x for _, x in CRIMES], STORIES))
    day = F.to_date("o_orderdate")
    cases = c.select(
        k.alias("case_id"), F.col("n_name").alias("district"), F.col("c_custkey").alias("station_id"), crime.alias("crime"), F.substring("o_orderpriority", 1, 1).cast("int").alias("gravity"), F.col("o_orderstatus").alias("status"),
        day.alias("registered"), F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + k % 24 * 3600).alias("occurred"),
        (12.9 + (k * 7919 % 10007) / 100070.0).alias("lat"), (77.5 + (k * 104729 % 10009) / 100090.0).alias("lon"), story.alias("story"), "c_name",
    )
    cases = scratch.store(cases.join(told, "case_id", "left").withColumn("facts", F.replace("story", F.lit("%s"), F.coalesce("told", F.lit("")))).drop("story", "told"), "cases")
    part = t.part.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("age"), F.when(F.col("p_type") == "ECONOMY", 1).otherwise(2).alias("gender"))
    phone = F.concat(F.lit("Phone:+91"), (9_000_000_000 + F.col("part") * 3 + F.col("case_id") % 3).cast("string"))
    vehicle = F.when((F.col("qty") > 40) & (F.col("line") == 2), F.concat(F.lit("Vehicle:"), F.format_string("KA-%02d-AB-%04d", F.col("supp") % 70 + 1, F.col("part") % 10_000)))
    account = F.when(F.col("flag") == "R", F.concat(F.lit("FinancialAccount:acct"), F.col("supp").cast("string"), F.lit("@ybl")))
    planted = lines.select("case_id", F.explode(F.array_compact(F.array(phone, vehicle, account))).alias("entity")).distinct()
    people = scratch.store(lines.join(part, "part").select((8 * F.col("case_id") + F.col("line")).alias("accused_id"), "case_id", "name", "age", "gender", "part", "line"), "people")
    arrests = people.where("line = 2").join(cases.select("case_id", "registered"), "case_id").select("case_id", "accused_id", F.date_add("registered", (F.col("case_id") % 30).cast("int")).alias("arrested_on"))
    return {
        "cases": cases.drop("c_name"),
        "accused": people.drop("part", "line"),
        "truth": people.select(F.col("part").alias("true_person"), "accused_id"),
        "arrests": arrests,
        "complainants": cases.select(F.col("case_id").alias("complainant_id"), "case_id", F.col("c_name").alias("name")),
        "victims": cases.select((3 * F.col("case_id")).alias("victim_id"), "case_id", F.concat(F.lit("Victim "), F.col("case_id").cast("string")).alias("name")),
        "sections": t.lineitem.where("l_linenumber > 2").select(F.col("l_orderkey").alias("case_id"), F.lit("IPC").alias("act"), (300 + F.col("l_linenumber")).cast("string").alias("section")).join(cases.select("case_id"), "case_id", "left_semi"),
        "lines": lines.select("case_id", "line", "part", "supp"),
        "planted": planted,
    }


_CRIME = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in CRIMES) + " END"
#: cases, li, people (with `part`, the true person) and ev (case_id, entity).
CORPUS = f"""
cases AS (SELECT o_orderkey AS case_id, n_name AS district, c_custkey AS station_id, {_CRIME} AS crime, CAST(o_orderpriority[1] AS INTEGER) AS gravity, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS registered,
  12.9 + (o_orderkey * 7919 % 10007) / 100070.0 AS lat, 77.5 + (o_orderkey * 104729 % 10009) / 100090.0 AS lon FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 li AS (SELECT l_orderkey AS case_id, l_linenumber AS line, min(l_partkey) AS part, min(l_suppkey) AS supp, max(l_quantity) AS qty, min(l_returnflag) AS flag FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey IN (SELECT case_id FROM cases) GROUP BY 1, 2),
 people AS (SELECT 8 * case_id + line AS id, case_id, line, p_name AS name, p_size AS age, CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 2 END AS gender, part FROM li JOIN part ON p_partkey = li.part),
 ev AS (SELECT case_id, 'Phone:+91' || (9000000000 + part * 3 + case_id % 3) AS entity FROM li UNION SELECT case_id, 'Vehicle:KA-' || lpad(CAST(supp % 70 + 1 AS VARCHAR), 2, '0') || '-AB-' || lpad(CAST(part % 10000 AS VARCHAR), 4, '0') FROM li WHERE qty > 40 AND line = 2
  UNION SELECT case_id, 'FinancialAccount:acct' || supp || '@ybl' FROM li WHERE flag = 'R')
"""
#: found: pairs (a, b) that rule A merges; ids: (id, component) of the merged; who: every accused with its identity.
IDENTITIES = f"""{CORPUS},
 pe AS (SELECT id, entity FROM people JOIN ev USING (case_id) WHERE entity NOT LIKE 'FinancialAccount:%'),
 met AS (SELECT DISTINCT x.id AS a, y.id AS b FROM pe x JOIN pe y ON x.entity = y.entity AND x.id < y.id),
 found AS (SELECT a, b FROM met JOIN people x ON x.id = a JOIN people y ON y.id = b WHERE x.case_id <> y.case_id AND x.gender = y.gender AND abs(x.age - y.age) <= 2
  AND least(jaro_winkler_similarity(split_part(x.name, ' ', 1), split_part(y.name, ' ', 1)), jaro_winkler_similarity(split_part(x.name, ' ', 2), split_part(y.name, ' ', 2))) >= 0.80),
 ed AS (SELECT a, b FROM found UNION SELECT b, a FROM found),
 re AS (SELECT a AS id, a AS m FROM ed UNION SELECT re.id, ed.b FROM re JOIN ed ON re.m = ed.a),
 ids AS (SELECT id, min(m) AS component FROM re GROUP BY 1),
 who AS (SELECT p.*, coalesce(component, p.id) AS identity, component IS NOT NULL AS resolved FROM people p LEFT JOIN ids USING (id))
"""
