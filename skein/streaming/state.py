"""Keyed state of streams."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_keyed_state(spark: SparkSession) -> None:
    """transformWithState keeps lists, maps and timers in RocksDB only: streams that start from now on use it."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
