"""A training corpus from documents: classify, filter by rules, drop near duplicates, redact, pack.

Every stage takes all its predecessor kept, and all but the last give back the columns that came, whatever their names; the
columns doc_id, text, lang and source must be there. Null texts are empty: the rules drop them, as they drop all texts of under 50
words. Null ids are kept, and rows that share an id are rows of their own. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import jaccard_join, packing, pii, quality_net, quality_rules
from tessellar.llm.common import materialize, table
from tessellar.llm.queries import vocabulary

#: Documents that score below this go.
LEAST_QUALITY = 0.5
#: Near duplicates share four fifths of their five-word shingles.
NEAR = jaccard_join.Join(width=5, percent=80)
#: Rows up to which a list of ids is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def apart(docs: DataFrame, used: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all but the columns that a stage reads renamed, and the way back: no column of the input clashes with a stage's own."""
    names = {c: c if c in used else f"_in_{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), lambda out: out.select(*[F.col(v).alias(k) for k, v in names.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = quality_net.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    named, back = apart(docs, ["text"])
    return back(quality_net.classify(named, net).filter(F.col("score") >= LEAST_QUALITY))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, back = apart(docs, ["text", "lang", "source"])
    return back(quality_rules.quality_rules(named).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id (null last), and of equal ids the smallest hash of id and text; rows without words stay.

    Rows are told apart by the hash of id and text, not by their id: rows that share an id and differ in text are no copies.
    """
    linked = materialize(jaccard_join.grouped(docs, NEAR).filter("n_shingles > 0"), "near")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")
    best = linked.groupBy("component").agg(F.min(order).alias("best"))
    gone = linked.join(best, "component").filter(F.col("key") != F.col("best.key")).select(F.col("key").alias("_gone")).distinct()
    twice = linked.groupBy("key").count().filter("count > 1").select(F.col("key").alias("_gone"))
    few = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    key = F.xxhash64("doc_id", "text")
    named, back = apart(docs, ["doc_id", "text"])
    kept = named.join(few(gone), key == F.col("_gone"), "left_anti")
    # rows that repeat both id and text
    repeated = few(twice)
    once = kept.join(repeated, key == F.col("_gone"), "left_semi").dropDuplicates(["doc_id", "text"])
    return back(kept.join(repeated, key == F.col("_gone"), "left_anti").unionByName(once))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; n_chars follows the new text."""
    out = pii.redact(docs, pii.trees(spark))
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
