"""Sources and sinks: JSON lines, Parquet tables of chunks, append without repeats, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "url string, html string, depth int"
CLEAN = "url string, title string, text string, language string"
ALLOWED_SUFFIXES = ("pdf", "docx", "txt", "md", "png", "jpg", "jpeg", "webp", "bmp")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).json(path)


def append_raw(pages: DataFrame, path: str, held: DataFrame | None = None) -> None:
    """Append pages whose URL is not held yet."""
    new = pages if held is None else pages.join(held.select("url"), "url", "left_anti")
    new.select("url", "html", "depth").write.mode("append").json(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN).json(path).withColumn("language", F.coalesce("language", F.lit("unknown")))


def write_clean(docs: DataFrame, path: str) -> None:
    docs.select("url", "title", "text", F.coalesce("language", F.lit("unknown")).alias("language")).write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A golden set or manifest; blank lines are skipped, and a missing file says what is missing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no golden set or manifest at {path}: one JSON object a line is expected there")
    return spark.read.schema(schema).json(path).na.drop("all")


def write_report(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def uploads(spark: SparkSession, path: str, most_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """Files with `problem`: null for an allowed suffix and a size from 1 byte to the limit. Spark's reader passes over empty files, so a listing of the folder adds them."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    problem = F.when(~suffix.isin(*ALLOWED_SUFFIXES), "type").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "size")
    found = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    hollow = [(x.getPath().toString(), 0, bytearray()) for x in listed if x.isFile() and not x.getLen()]
    found = found.filter("length > 0").unionByName(spark.createDataFrame(hollow, "path string, length long, content binary"))
    return found.withColumns({"suffix": suffix, "problem": problem})


#: The letters of bytes 128 to 255 in Latin-1 and in Windows-1256, which Spark's decode does not know.
_HIGH = [bytes(range(128, 256)).decode(c) for c in ("latin-1", "cp1256")]


def decode_text(content):
    """Bytes as UTF-8 where valid, else as Windows-1256, which has a letter for every byte."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.translate(F.decode(content, "iso-8859-1"), *_HIGH))


def safe_name(name):
    """Base name without NUL and outer blanks; a default for nothing."""
    base = F.trim(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), "\x00", ""))
    return F.when(base.isin("", ".", ".."), "upload.bin").otherwise(base)


def inside(root: str, name):
    """The path of an upload below a session's folder, failing on a name that would leave it."""
    path = F.concat(F.lit(root.rstrip("/") + "/"), safe_name(name))
    return F.when(path.rlike(r"(^|/)\.\.(/|$)"), F.raise_error(F.lit("the path leaves the session's folder"))).otherwise(path)
