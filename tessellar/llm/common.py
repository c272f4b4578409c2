"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import _written, materialize, release, shared_dir

__all__ = ["_written", "materialize", "release", "shared_dir"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most `rows` rows at once to a Python worker, for the rest of the session: texts are long, and both sides hold a batch whole."""
    now = int(spark.conf.get(BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A to Z alone, whatever the locale."""
    return F.translate(col, UPPER, UPPER.lower())


def fold(col, modulus: int):
    """crc32 of the decimal id, modulo: the split between training and held-out rows."""
    return F.pmod(F.crc32(F.encode(col.cast("string"), "UTF-8")), F.lit(modulus))
