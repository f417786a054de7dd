"""Session building and the few settings every part of the library relies on."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a local session leaves it unset, a temporary folder of this machine serves; on a cluster
    that would be unreadable for other executors, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


_LOCAL: list[str] = []


def _local_folder() -> str:
    if not _LOCAL:
        keep = tempfile.TemporaryDirectory(prefix="skein-")
        atexit.register(keep.cleanup)
        _LOCAL.append(keep.name)
    return _LOCAL[0]


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go away as soon as each query ends."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    try:
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
    except Exception:  # an older Spark without the setting keeps its files until garbage collection
        before = None
        yield
        return
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for what runs inside; the caller's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Scratch tables hold rows of a few bytes or of several MB. Parquet looks at sizes only every 100 rows by default, so that 100 rows of MB
#: are one page, which is written and read as a whole by every task. Here the size is looked at from the first row on, and a row
#: group, the most that a reader takes at once, ends at 8 MB.
PARQUET = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}

#: Roots of scratch tables by application; a result may read them until the application ends.
_ROOTS: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_scratch() -> None:
    for spark, root in _ROOTS:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            _delete(spark, root)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors. What drop()
    leaves is removed when the application ends, as results are read from it.

    >>> s = Scratch(spark, "components")
    >>> labels = s.store(labels, "labels-1")   # written, read back
    >>> s.drop("labels-0")                     # an older one that nothing reads any more
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/skein/{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").options(**PARQUET).option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            _delete(self.spark, self.path(name) if name else self.root)
