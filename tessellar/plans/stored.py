"""What several queries read: an inverted index for each version of a table, in the folder that the cluster shares."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import blockmax, retriever, search, store
from ..sources.shared import remember, shared_dir


def _place(spark: SparkSession, sf_dir: str, kind: str, *tables: str) -> str:
    """A folder for what is made of these tables, in this version of their files (names, sizes, times) and this session."""
    name: list = [spark.sparkContext.applicationId]
    for table in tables:
        source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{table}.parquet")
        fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        name += [source, fs.getContentSummary(source).getLength(), fs.getFileStatus(source).getModificationTime()]
    return f"{shared_dir(spark)}/{kind}-{hashlib.sha256('|'.join(map(str, name)).encode()).hexdigest()[:24]}"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def index(spark: SparkSession, sf_dir: str, fresh: bool = False) -> search.Index:
    """The inverted index of `documents`: built once for this version of its files and session, then opened."""
    source, path = f"{sf_dir.rstrip('/')}/documents.parquet", _place(spark, sf_dir, "index", "documents")
    if fresh or not _exists(spark, f"{path}/totals/_SUCCESS"):
        remember(spark, path)
        return search.Index.build(spark.read.parquet(source).select("doc_id", "text"), path)
    return search.Index.open(spark, path)


def blocks(spark: SparkSession, sf_dir: str) -> blockmax.Blocks:
    """Bounds of the blocks of the index of `documents`, made once."""
    path = _place(spark, sf_dir, "blocks", "documents")
    if not _exists(spark, f"{path}/told/_SUCCESS"):
        remember(spark, path)
        return blockmax.Blocks.build(index(spark, sf_dir), path)
    return blockmax.Blocks.open(spark, path)


def chunks(spark: SparkSession, sf_dir: str) -> retriever.Retriever:
    """`documents` as stored chunks with the vectors of `embeddings` (vec_id = doc_id), indexed: ids that end in 7, 8 or 9 belong to the sessions s7, s8 and s9, all others are shared."""
    path = _place(spark, sf_dir, "chunks", "documents", "embeddings")
    held = store.Chunks(spark, path)
    found = retriever.Retriever(held, path)
    if not _exists(spark, f"{path}/cells/centres/_SUCCESS"):
        remember(spark, path)
        docs, vectors = (spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("documents", "embeddings"))
        own = F.col("doc_id") % 10 >= 7
        named = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(
            F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), "text", F.lit("").alias("title"), F.when(own, "").otherwise(F.col("source")).alias("url"), F.col("lang").alias("language"), F.when(own, store.OWN).otherwise(store.SHARED).alias("source_kind"),
            F.when(own, F.concat(F.lit("s"), F.col("doc_id") % 10)).alias("session_id"), F.when(own, F.col("source")).alias("doc_name"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), F.col("embedding").cast("array<float>").alias("embedding"),
        )
        held.shared.replace(named.filter("session_id is null"))
        held.own.replace(named.filter("session_id is not null"))
        found.refresh()
    return found
