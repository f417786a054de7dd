"""Token counts by a digest cache (operator 10).

A text's key is the SHA-256 of its normalised content with the digest of the tokenizer's file and
library version. Keys are joined to the stored counts; each distinct text without one is encoded
once, and its count is appended to the cache. The text itself is never changed: normalised means
that null counts as empty.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows may repeat, each is returned; a
null doc_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import texts, tokens
from skein.session import Scratch, shuffles_dropped

CACHE = "key binary, n_tokens long, version string"


def _counts(name: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = tokens.counter(name)
        for batch in batches:
            _, offsets = texts.buffers(batch.column(1))
            for lo, hi in texts.pieces(batch.num_rows, offsets, 1 << 20):
                n = [sum(x) for x in units(batch.column(1).slice(lo, hi - lo).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64())], ["key", "n_tokens"])

    return fn


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's counts of one tokenizer version; a key that was appended twice counts once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "key binary, n_tokens long")
    return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); new counts go to the cache."""
    spark = docs.sparkSession
    version = tokens.version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(F.concat(F.lit(f"{version} ").cast("binary"), text.cast("binary")), 256)).alias("key"))
    misses = keyed.select("key", "text").join(stored_counts(spark, cache, version), "key", "left_anti").dropDuplicates(["key"])
    with shuffles_dropped(spark):
        misses.mapInArrow(_counts(tokenizer), "key binary, n_tokens long").withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    found = stored_counts(spark, cache, version)
    out = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key").join(found, "key")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "piece_bpe_32k.model", Scratch(spark, "token-counts").path("cache"))
