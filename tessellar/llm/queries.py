"""The queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, hard_negatives, hilbert_ann, jaccard_join, oracles, packing, pii, pitman_yor, quality_net, repeats, tokens, toxicity
from . import quality_rules as qr
from .common import fold, materialize, table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = materialize(qr.with_metrics(docs).drop("text"), "op10")  # counts only: the texts are read and measured once
    limits = materialize(qr.cutoffs(qr.sketches(measured), qr.Rules()), "op10-limits")
    return qr.judge(measured, limits).select("doc_id", *qr.METRICS, "base_failed", "kept")


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_text=False)
    decoded = bpe.decode(encoded, ranks).drop("id_list")
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary() -> tuple[str, str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokens.attribute(table(spark, sf_dir, "documents"), vocabulary())


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op6_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 4) == 2
    net = quality_net.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_net.classify(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.trees(spark)).drop("text")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.told("base"), 256).alias("base_sha256"), pii.told("found").alias("spans"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op11_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op13_collocations": op13_collocations,
    "op11_super_kmers": op11_super_kmers,
    "op12_hard_negatives": op12_hard_negatives,
    "op2_hilbert_neighbours": op2_hilbert_neighbours,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_pii_boosting": op4_pii_boosting,
    "op6_quality_net": op6_quality_net,
    "op7_toxicity": op7_toxicity,
    "op9_pitman_yor": op9_pitman_yor,
    "op1_lexical_packing": op1_lexical_packing,
    "op5_token_counts": op5_token_counts,
    "op8_byte_level_bpe": op8_byte_level_bpe, "op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {"op3_jaccard_join": oracles.OP3, "op10_quality_rules": oracles.OP10, "op11_super_kmers": oracles.OP11, "op12_hard_negatives": oracles.OP12, "op13_collocations": oracles.OP13}
