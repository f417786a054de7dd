"""Benchmark decontamination (operator 3): containment search by bottom-k prefixes, verified by exact shingle containment.

Not the size-partitioned MinHash of the operator's name: the estimate of a signature loses leaks (figures in the README), so its
place is taken by an exact filter. A test item of n distinct k-word shingles leaks into a document that holds at least
ceil(percent * n / 100) of them. At most n - ceil(percent * n / 100) of an item's shingles can be missing, so a leak has
one of the item's n - ceil(percent * n / 100) + 1 smallest hashes: how many are kept follows from the item's size.
Every shingle of every document probes these, so no leak is missed; of the documents that meet
one, the shingles' strings are counted for each item: exact containment. Strings are joined as rows, so no
document's shingles are gathered or copied for each item.

All steps are DataFrame operations. Items are broadcast only if their counted size is small; beyond
that Spark chooses the join.

Defined cases: words are runs of other characters than 0x20 and 0x09-0x0D, with A-Z lowered; an item
or document with fewer than k words has no shingles, and neither leaks nor holds a leak; null texts
and null ids take no part; rows with one id count as one item or document (a leak lies in a row's
whole text); other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Counted size of the items' shingles up to which they and their minima are broadcast.
BROADCAST_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Words in a cleaned text: one space between them, none around."""
    clean = F.btrim(F.translate(text, _UPPER + "\t\n\x0b\x0c\r", _LOWER + "     "), F.lit(" "))
    return F.filter(F.split(clean, " +"), lambda x: x != "")


def _starts(words: Column, k: int) -> Column:
    """0-based starts of the k-word shingles; none where there are fewer words."""
    n = F.size(words) - k
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, k: int) -> Column:
    return F.transform(_starts(words, k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def _strings(words: Column, k: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, k), lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(k)))))


def _need(n: Column, percent: int) -> Column:
    """ceil(percent * n / 100) in integers."""
    return ((n * percent + 99) / 100).cast("long")


def item_signatures(items: DataFrame, k: int, percent: int) -> DataFrame:
    """(item_id, item, grams, n, minima): an item's distinct shingles, their number and its smallest hashes; item tells
    rows of one id with different texts apart."""
    w = items.where("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("item"), _words(F.col("text")).alias("w"))
    grams = w.select("item_id", "item", _strings(F.col("w"), k).alias("grams"), F.array_sort(F.array_distinct(_hashes(F.col("w"), k))).alias("h")).where("size(grams) > 0")
    n = F.size("grams")
    return grams.select("item_id", "item", "grams", n.cast("long").alias("n"), F.slice("h", F.lit(1), (n - _need(n, percent) + 1).cast("int")).alias("minima"))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Leaks: (doc_id, item_id, shared, item_shingles); one row for each document and item."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("doc"), "text")
    signed = item_signatures(items, k, percent)
    minima = signed.select(F.explode("minima").alias("hash")).distinct()
    grams = signed.select("item_id", "item", "n", F.explode("grams").alias("gram")).distinct()
    size = grams.agg(F.coalesce(F.sum(F.octet_length("gram") + 40), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        minima, grams = F.broadcast(minima), F.broadcast(grams)
    probes = docs.select("doc_id", "doc", _words(F.col("text")).alias("w")).select("doc_id", "doc", F.explode(_hashes(F.col("w"), k)).alias("hash"))
    met = probes.join(minima, "hash", "left_semi").select("doc_id", "doc").distinct()
    # words stand in a step of their own: inside the shingles' function they would be split again for each shingle
    held = docs.join(met, ["doc_id", "doc"], "left_semi").dropDuplicates(["doc_id", "doc"]).select("doc_id", "doc", _words(F.col("text")).alias("w"))
    held = held.select("doc_id", "doc", _strings(F.col("w"), k).alias("grams")).select("doc_id", "doc", F.explode("grams").alias("gram"))
    pairs = held.join(grams, "gram").groupBy("doc_id", "doc", "item_id", "item", "n").agg(F.count("*").alias("shared"))
    best = pairs.where(100 * F.col("shared") >= percent * F.col("n")).groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", "n")).alias("m"))
    return best.select("doc_id", "item_id", "m.shared", F.col("m.n").alias("item_shingles"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH w AS (SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, item_id, -row_number() OVER (), text FROM benchmark),
 l AS (SELECT kind, id, r, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM w WHERE id IS NOT NULL AND text IS NOT NULL),
 s AS (SELECT DISTINCT kind, id, r, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT kind, id, r, w, unnest(range(1, len(w) - 3)) AS i FROM l WHERE len(w) >= 5)),
 n AS (SELECT r, count(*) AS n FROM s WHERE kind = 1 GROUP BY r)
SELECT doc_id, item_id, max(c) AS shared, max(n) AS item_shingles FROM (
 SELECT d.id AS doc_id, i.id AS item_id, i.r, count(*) AS c FROM s d JOIN s i ON d.g = i.g AND d.kind = 0 AND i.kind = 1 GROUP BY d.id, d.r, i.id, i.r) JOIN n USING (r)
WHERE 100 * c >= 80 * n GROUP BY doc_id, item_id
"""
