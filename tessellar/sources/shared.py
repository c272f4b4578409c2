"""Tables in the folder that the driver and all executors share: where a lineage ends and what queries keep."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and the session is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessellar-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def remember(spark: SparkSession, path: str) -> None:
    """A folder that goes when the driver ends."""
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of what is written go when the write ends, and not with some later collection of the driver's garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, bucketed: tuple[str, int] | None = None, compression: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends in replicated files, not in executor memory.

    bucketed: a column and a number of buckets; what groups by the column then needs no exchange.
    """
    spark, unique = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tessellar-{unique}"
    writer = df.write.option("compression", compression) if compression else df.write
    remember(spark, path)
    if bucketed is None:
        with freed(spark):
            writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = "tessellar_" + unique.replace("-", "_")
    with freed(spark):
        writer.bucketBy(bucketed[1], bucketed[0]).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def _clean() -> None:
    for spark, path in _written:
        release(spark, path)


def release(spark: SparkSession, path: str) -> None:
    """Drop a folder; a session that has ended already is no error."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    try:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        return
