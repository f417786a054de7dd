"""One audit chain over all micro-batches of a stream.

A batch goes on from the heads that the batches before it left: it looks up those of its own chains, extends them,
and writes its entries, its heads and at last its commit, each to a folder of its own. Only committed batches are read,
by readers and by later batches. A batch that is killed midway has no commit and changes nothing; one that runs
again, before or after its commit, reads the same heads, makes the same hashes and replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from skein.operators import governance


class AuditLog:
    """AuditLog(spark, folder) is a foreachBatch sink for rows (chain, seq, payload); null chains are chains of their own.

    Entries of a chain are ordered by batch, then seq, then payload; `place` counts them from 1 over all batches."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.folder, self.buckets = folder, buckets
        spark.createDataFrame([], "chain string, head string, place long").write.mode("overwrite").parquet(f"{folder}/heads/batch=-1/bucket=0")
        spark.createDataFrame([(True,)], "done boolean").write.mode("overwrite").parquet(f"{folder}/commits/batch=-1")

    def _committed(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/commits").select("batch").distinct()

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("chain"), F.lit(self.buckets)).cast("int")

    def heads(self, spark: SparkSession, before: int, buckets: list[int] | None = None) -> DataFrame:
        """(chain, head, last): the newest head of each chain as of before a batch, in the given buckets."""
        rows = spark.read.parquet(f"{self.folder}/heads").where(F.col("batch") < before)
        rows = rows.where(F.col("bucket").isin(buckets)) if buckets is not None else rows
        return rows.join(F.broadcast(self._committed(spark)), "batch", "left_semi").groupBy("chain").agg(F.max_by(F.struct("head", "place"), "batch").alias("h")).select("chain", "h.head", F.col("h.place").alias("last"))

    def __call__(self, entries: DataFrame, batch: int, fail: str | None = None) -> None:
        """`fail` names a step before which to stop, as if killed (for tests)."""
        spark = entries.sparkSession
        rows = entries.select(F.col("chain").cast("string").alias("chain"), "seq", "payload").withColumn("bucket", self._bucket())
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
        rows = rows.join(self.heads(spark, batch, touched).withColumnRenamed("chain", "_chain"), F.col("chain").eqNullSafe(F.col("_chain")), "left").drop("_chain")
        order = W.partitionBy("chain").orderBy("seq", "payload")
        rows = rows.withColumn("place", F.coalesce("last", F.lit(0).cast("long")) + F.row_number().over(order))
        out = governance.chained(rows.withColumn("payload", F.coalesce("payload", F.lit(""))), "chain", "place", "payload", "head").drop("head", "last")
        self._step("entries", fail)
        out.write.mode("overwrite").parquet(f"{self.folder}/entries/batch={batch}")
        self._step("heads", fail)
        made = spark.read.schema(out.schema).parquet(f"{self.folder}/entries/batch={batch}")
        made.groupBy("chain", "bucket").agg(F.max_by("entry_hash", "place").alias("head"), F.max("place").alias("place")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/heads/batch={batch}")
        self._step("commit", fail)
        spark.createDataFrame([(True,)], "done boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")

    @staticmethod
    def _step(name: str, fail: str | None) -> None:
        if name == fail:
            raise InterruptedError(f"stopped before {name}")

    def entries(self, spark: SparkSession) -> DataFrame:
        """(chain, place, seq, payload, prev_hash, entry_hash, batch) of all committed batches."""
        rows = spark.read.parquet(f"{self.folder}/entries")
        return rows.join(F.broadcast(self._committed(spark)), "batch", "left_semi").select("chain", "place", "seq", "payload", "prev_hash", "entry_hash", "batch")

    def broken(self, spark: SparkSession) -> DataFrame:
        """W09 over all batches: the first entry of each chain that was changed, is missing, or does not follow its predecessor."""
        rows = self.entries(spark)
        missing = rows.groupBy("chain").agg(F.max("place").alias("most"), F.count("*").alias("n"), F.min("place").alias("least")).where("n <> most or least <> 1").select("chain")
        gaps = rows.join(missing, "chain", "left_semi").withColumn("_n", F.row_number().over(W.partitionBy("chain").orderBy("place"))).where("_n <> place").groupBy("chain").agg(F.min("place").alias("first_bad"))
        return governance.broken(rows, "chain", "place", "payload").union(gaps).groupBy("chain").agg(F.min("first_bad").alias("first_bad"))
