"""Uploaded files to a session's chunks: dispatch by suffix, page texts, recognised boxes in reading order, ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import curate, store
from . import files
from .shared import materialize
from .versioned import Table

TEXT_SUFFIXES, IMAGE_SUFFIXES = ("txt", "md"), ("png", "jpg", "jpeg", "webp", "bmp")
#: A page's own text below this many characters is weighed against a recognised one.
SHORT_PAGE = 60


def longer_text(own: Column, recognised: Column) -> Column:
    """A page's text: a short one gives way to the recognised text if that is longer."""
    own, other = F.coalesce(own, F.lit("")), F.coalesce(recognised, F.lit(""))
    return F.when((F.length(F.trim(own)) < SHORT_PAGE) & (F.length(F.trim(other)) > F.length(F.trim(own))), other).otherwise(own)


def reading_order(boxes: DataFrame, by: str) -> DataFrame:
    """(by, text) from recognised boxes (by, box: array of points, text, confidence): lines from top to bottom, boxes from left to right.

    Boxes without text or below the least confidence go. A box opens a line if its middle lies more than 0.6 of the upper median
    height, and 6 at least, from that of the box before it.
    """
    kept = boxes.filter((F.coalesce("text", F.lit("")) != "") & (F.col("confidence") >= fixed.LEAST_BOX))
    ys, xs = F.transform("box", lambda p: p[1]), F.transform("box", lambda p: p[0])
    placed = kept.select(by, F.trim("text").alias("text"), (F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size("box")).alias("y"), F.array_min(xs).alias("x"), (F.array_max(ys) - F.array_min(ys)).alias("h"), F.monotonically_increasing_id().alias("i"))
    ranked = Window.partitionBy(by).orderBy("h", "i")
    size = F.count("*").over(Window.partitionBy(by))
    sized = placed.withColumn("r", F.row_number().over(ranked) - 1).withColumn("mid", F.max(F.when(F.col("r") == F.floor(size / 2), F.col("h"))).over(Window.partitionBy(by)))
    down = Window.partitionBy(by).orderBy("y", "i")
    opens = (F.abs(F.col("y") - F.lag("y").over(down)) > F.greatest(0.6 * F.col("mid"), F.lit(6.0))).cast("int")
    lined = sized.withColumn("new", F.coalesce(opens, F.lit(0))).withColumn("line", F.sum("new").over(down))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda s: s["text"]), " ")
    lines = lined.groupBy(by, "line").agg(joined(F.collect_list(F.struct("x", "y", "i", "text"))).alias("t")).filter(F.trim("t") != "")
    return lines.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n").alias("text"))


def parse(uploads: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(path, page, text) of sound uploads (path, content, suffix, problem): text files are decoded, other suffixes go to the caller's readers.

    A suffix without a reader gives no pages, and pages without text go.
    """
    sound = uploads.filter("problem is null")
    out = sound.filter(F.col("suffix").isin(*TEXT_SUFFIXES)).select("path", F.lit(1).alias("page"), files.decode_text(F.col("content")).alias("text"))
    for suffix, reader in (readers or {}).items():
        out = out.unionByName(reader(sound.filter(F.col("suffix") == suffix)).select("path", "page", "text"))
    return out.filter(~F.coalesce("text", F.lit("")).rlike(r"(?U)^\s*$"))


def kept_files(spark: SparkSession, path: str) -> Table:
    """The files that sessions have uploaded, by session and name."""
    return Table(spark, path, "session_id string, doc_name string, content binary", ("session_id", "doc_name"))


def ingest(uploads: DataFrame, session_id: str, chunks: store.Chunks, readers: dict[str, Callable[[DataFrame], DataFrame]] | None = None, kept: Table | None = None) -> DataFrame:
    """Sound uploads into one session's chunks; (doc_name, pages, chunks, language, problem) of every file.

    A file that is refused, unreadable or without indexable text makes no chunks and says so. With `kept` (see kept_files) the others are
    saved there, and one saved before under the name of a file that failed goes.
    """
    store.need_session(session_id)
    named = uploads.withColumn("doc_name", files.safe_name(F.col("path")))
    pages = parse(uploads, readers).withColumn("doc_name", files.safe_name(F.col("path")))
    whole = pages.groupBy("doc_name").agg(F.count("*").alias("pages"), F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("page", "text"))).getField("text")).alias("all"))
    told = whole.select("doc_name", "pages", text.language(F.col("all")).alias("language"))
    rows = pages.join(told.select("doc_name", "language"), "doc_name").select("text", F.col("doc_name").alias("title"), F.lit("").alias("url"), "language", F.lit(session_id).alias("session_id"), "doc_name", F.col("page").cast("int").alias("page"))
    made = curate.chunk_rows(rows, store.OWN)
    chunks.add_own(made, session_id)
    counts = chunks.of_session(session_id).groupBy("doc_name").agg(F.count("*").alias("chunks"))
    out = named.select("doc_name", "problem").join(told, "doc_name", "left").join(counts, "doc_name", "left").na.fill(0, ["pages", "chunks"])
    told = out.withColumn("problem", F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("pages") == 0, "no readable text").when(F.col("chunks") == 0, "no indexable content"))
    if kept is None:
        return told
    told = materialize(told, "uploads")
    files_ = named.select(F.lit(session_id).alias("session_id"), "doc_name", "content").dropDuplicates(["doc_name"])
    kept.upsert(files_.join(told.filter("problem is null").select("doc_name"), "doc_name", "left_semi"))
    failed = told.filter("problem is not null").select("doc_name")
    kept.delete(F.col("doc_name").isin([r[0] for r in failed.collect()]), first=session_id)  # the names of one upload
    return told
