"""Person search for many queries at once, without scoring every name.

A name can only reach the threshold in one of three ways, and each has an index over distinct strings:

* by the ratio of the whole strings: it is at most twice the characters in common over both lengths;
* by containing the query: it has the query's rarest pair of letters;
* by a pair of tokens with a Jaro-Winkler similarity of the threshold: without its bonus, which starts over 0.7,
  at least m / a + m / b >= 1.1 for m characters in common of a and b. Token pairs are compared once, as distinct tokens.

Characters in common are found by prefix filtering: the characters of a string, numbered where they repeat, rarest
first; two strings that share m of them meet in the first n - m + 1 of both, for every length n the other may have.
Names that come out of an index are scored once for each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skein.functions import names
from skein.session import Scratch


def _characters(strings: DataFrame, frequency: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((s, n, c, pos) of the distinct strings, rarest character first, and the characters' numbers (c, df))."""
    chars = F.filter(F.split("s", ""), lambda c: c != "")
    each = strings.where("s is not null and s <> ''").distinct().select("s", F.length("s").alias("n"), F.explode(chars).alias("c"))
    each = each.groupBy("s", "n", "c").agg(F.count("*").alias("k")).select("s", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.concat(F.col("c"), i.cast("string")))).alias("c"))
    frequency = each.groupBy("c").agg(F.count("*").alias("df")) if frequency is None else frequency
    known = each.join(frequency, "c", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    return known.withColumn("pos", F.row_number().over(W.partitionBy("s").orderBy("df", "c"))).drop("df"), frequency


def _alike(queries: DataFrame, strings: DataFrame, need, shortest: float) -> DataFrame:
    """(q, s): the pairs whose strings can share need(length, length) characters. `shortest` is the least share of one
    length that the other may have."""
    own, frequency = _characters(strings)
    asked, _ = _characters(queries.select(F.col("q").alias("s")), frequency)
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("n") * shortest - 1e-9)).cast("int"), F.floor(F.col("n") / shortest + 1e-9).cast("int"))
    asked = asked.select(F.col("s").alias("q"), F.col("n").alias("nq"), "c", F.col("pos").alias("pq"), F.explode(lengths).alias("n"))
    m = F.greatest(F.lit(1), F.ceil(need(F.col("nq"), F.col("n")) - 1e-9))
    asked = asked.withColumn("m", m).where((F.col("m") <= F.least("nq", "n")) & (F.col("pq") <= F.col("nq") - F.col("m") + 1))
    met = asked.join(own, ["n", "c"]).where(F.col("pos") <= F.col("n") - F.col("m") + 1)
    return met.select("q", "s").distinct()


def _tokens(text: Column, forms: Column) -> Column:
    spelled = F.concat(F.array(text), F.coalesce(forms, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.flatten(F.transform(spelled, lambda f: F.split(F.lower(F.trim(f)), r"\s+"))), lambda x: x != ""))


def candidates(queries: DataFrame, known: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(query, name): the pairs of distinct queries (query) and names (name) that can reach the threshold, over 0.7."""
    if threshold <= 0.7:
        raise ValueError("the bounds hold for thresholds over 0.7")
    scratch = Scratch(queries.sparkSession, "search")
    q = queries.select("query").distinct().select("query", F.lower(F.trim("query")).alias("q"), names.romanised("query").alias("forms")).where("q <> ''")
    n = known.select("name").distinct().select("name", F.lower(F.trim("name")).alias("s"), names.romanised("name").alias("forms")).where("s <> ''")
    q, n = scratch.store(q, "queries"), scratch.store(n, "names")
    whole = _alike(q, n.select("s"), lambda a, b: threshold * (a + b) / 2, threshold / (2 - threshold))

    def grams(text: str) -> Column:
        return F.array_distinct(F.concat(F.filter(F.split(text, ""), lambda c: c != ""), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 1)), lambda i: F.substr(text, i, F.lit(2)))))

    index = n.select("s", F.explode(grams("s")).alias("g")).where("g <> ''").distinct()
    frequency = index.groupBy("g").agg(F.count("*").alias("df"))
    wanted = q.select("q", F.explode(grams("q")).alias("g")).where(F.length("g") == F.least(F.length("q"), F.lit(2))).join(frequency, "g", "left")
    # the query's rarest pair of letters, or its one letter
    rarest = wanted.groupBy("q").agg(F.min(F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), "g")).alias("r")).select("q", F.col("r.g").alias("g"))
    inside = rarest.join(index, "g").where(F.contains("s", F.col("q"))).select("q", "s")
    asked = q.select("q", F.explode(_tokens(F.col("q"), F.col("forms"))).alias("token"))
    held = n.select("s", F.explode(_tokens(F.col("s"), F.col("forms"))).alias("token"))
    tokens = _alike(asked.select(F.col("token").alias("q")).distinct(), held.select(F.col("token").alias("s")).distinct(), lambda a, b: 1.1 * a * b / (a + b), 0.1)
    close = scratch.store(tokens.where(names.jaro_winkler("q", "s") >= threshold - 1e-9).toDF("token", "other"), "close")
    by_token = asked.join(close, "token").select("q", F.col("other").alias("token")).distinct().join(held, "token").select("q", "s")
    pairs = whole.union(inside).union(by_token).distinct()
    return pairs.join(q.select("query", "q"), "q").join(n.select("name", "s"), "s").select("query", "name")


def person_searches(people: DataFrame, queries: DataFrame, groups: DataFrame, threshold: float = 0.72, rows: int = 40, limit: int = 8) -> DataFrame:
    """(query, rank, identity, name, score, size). For each query the first `rows` people (accused_id, name) by score,
    size of their identity and id, of these one for each identity, at most `limit`. groups: (id, component)."""
    scratch = Scratch(people.sparkSession, "searches")
    scored = scratch.store(candidates(queries, people, threshold), "candidates").withColumn("score", F.round(names.search_score("query", "name"), 6)).where(F.col("score") >= threshold)
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    who = people.select("accused_id", "name").join(groups.withColumnRenamed("id", "accused_id"), "accused_id", "left").join(sizes, "component", "left")
    who = who.select("accused_id", "name", F.coalesce("component", "accused_id").alias("identity"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))
    # of people with one name no more than `rows` can count
    first = who.withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy(F.desc("size"), "accused_id"))).where(F.col("_n") <= rows).drop("_n")
    hit = scored.join(first, "name").withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.desc("size"), "accused_id"))).where(F.col("_n") <= rows)
    one = hit.withColumn("_n", F.row_number().over(W.partitionBy("query", "identity").orderBy(F.desc("score"), "accused_id"))).where("_n = 1")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.desc("size"), "identity")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "identity", "name", "score", "size")

