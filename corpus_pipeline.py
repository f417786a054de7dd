"""A corpus pipeline of five operators: raw documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns
the columns of docs; the last returns pieces. run() writes each stage's rows as Parquet and reads
them again as the next one's docs.

    toxicity          trains on `labels`; documents with a score of 0.3 or more go
    near_duplicates   5-word shingles, Jaccard 0.8 or more; the smallest id of each group stays
    repeated_passages windows of 13 words that a smaller id has are cut out of the text
    decontamination   documents that hold 80 % of a benchmark item's 5-word shingles go
    packing           harmonic packing into sequences of at most 2048 ids

A row without doc_id passes the middle three unchanged: they compare documents by id. Rows that
repeat an id count as one document, of which near_duplicates keeps one row (the smallest text). A
text that is cut keeps its other words joined by one space, and n_chars follows where there is one;
a document of which nothing is left stays, with an empty text.

Defined cases: a null text counts as empty where it is scored and packed, and otherwise is compared with
nothing and stays null; an empty text stays; very long texts are worked on whole; equal texts of different
ids are near duplicates, of which the smallest id stays; columns besides doc_id, text and n_chars are carried
along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm.decontaminate import contained_items
from skein.llm.ngram_join import jaccard_components
from skein.llm.packing import packed_sequences
from skein.llm.substring_dedup import repeated_spans
from skein.llm.toxicity import toxicity_scores, train
from skein.session import Scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return toxicity_scores(whole, model).where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_components(docs, k=5, percent=80)
    # rows that repeat an id are few as a rule: only they are brought together, the others stay where they are
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("least"))
    alone = docs.join(ids.where("n > 1 or least <> doc_id").select("doc_id"), "doc_id", "left_anti")
    several = docs.join(ids.where("n > 1 and least = doc_id").select("doc_id"), "doc_id", "left_semi")
    first = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("row")).select("row.*")
    return alone.select(*docs.columns).unionByName(first)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeated_spans(docs, window=13).where("n_removed > 0").select("doc_id", "tag", "kept").dropDuplicates(["doc_id", "tag"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("tag")).join(cut, ["doc_id", "tag"], "left")
    text = F.coalesce("kept", "row.text")
    new = {"text": text} | ({"n_chars": F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_sequences(docs, "word_bpe_49k.json", 1)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return docs
