"""Insights over turn records, latency tables, evaluation of retrieval, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


#: Half the width, as a share of the ranks, of the bracket around a percentile; ten times the error of the approximate one.
_BRACKET = 0.001


def percentile_table(rows: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """by, n, and p<percent> by nearest rank, clamp(round_half_even(percent / 100 * n + 0.5), 1, n), exactly; nulls are left out.

    No group is sorted in one task, whatever its size: approximate percentiles, which merge from partial ones, bracket each rank;
    a second pass counts what lies below a bracket and each value within it, and ranks run over those values alone.
    """
    v = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    shares = [x for p in percents for x in (max(p / 100 - _BRACKET, 0.0), min(p / 100 + _BRACKET, 1.0))]
    cuts = v.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", shares, 10_000).alias("_c"))
    at = lambda p: F.greatest(F.lit(1), F.least(F.col("_n"), F.rint(F.lit(p / 100) * F.col("_n") + 0.5).cast("long")))
    asked = [F.struct(F.lit(p).alias("p"), at(p).alias("at"), F.col("_c")[2 * i].alias("lo"), F.col("_c")[2 * i + 1].alias("hi")) for i, p in enumerate(percents)]
    asked = cuts.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_n", F.array(*asked).alias("_asked"))
    met = v.join(asked, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    each = met.select(*by, "_n", "_v", F.explode("_asked").alias("_a")).filter(F.col("_v") <= F.col("_a.hi"))
    inside = F.col("_v") >= F.col("_a.lo")
    counted = each.groupBy(*by, "_n", F.col("_a.p").alias("_p"), F.col("_a.at").alias("_at"), F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "_p").orderBy(F.col("_v").asc_nulls_first()))
    found = counted.withColumn("_upto", upto).filter(F.col("_v").isNotNull() & (F.col("_upto") >= F.col("_at")))
    return found.groupBy(*by).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])


def sample_window(rows: DataFrame, by: str, order: list[str], most: int = 2000) -> DataFrame:
    """The last `most` rows of each group."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


#: Hashed sums that stand for all values of a column.
BUCKETS = 1 << 16


def most_common(rows: DataFrame, column: str, order: str, k: int = 5) -> DataFrame:
    """(column, n): the k most frequent values; ties to the first seen.

    The values are not all shuffled: rows are counted by a hash of the value, BUCKETS sums at most, and the values of the k fullest buckets
    are counted exactly. The k-th best of those is a threshold, and only buckets that reach it can hold a better value; theirs are counted.
    """
    bucket = F.pmod(F.xxhash64(column), F.lit(BUCKETS))
    sums = rows.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n"))
    fullest = [r[0] for r in sums.orderBy(F.desc("_n"), "_b").limit(k).collect()]

    def counted(keep: Column) -> DataFrame:
        return rows.filter(keep).groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(k)

    least = counted(bucket.isin(fullest)).agg(F.when(F.count("*") == k, F.min("n")).otherwise(0).alias("least")).first()[0] if fullest else 0
    heavy = F.broadcast(sums.filter(F.col("_n") >= least).select("_b"))  # BUCKETS rows at most
    return rows.withColumn("_b", bucket).join(heavy, "_b", "left_semi").groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(k).drop("first")


def recall_mrr(ranked: DataFrame, by: list[str], latency: str | None = None) -> DataFrame:
    """by, n, recall, mrr (and median_latency_ms, interpolated) from rows (query, by..., hit_rank or null), overall and by group: grouping sets."""
    more = [F.round(F.median(latency), 1).alias("median_latency_ms")] if latency else []
    return ranked.groupingSets([[], by], *by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit_rank").isNotNull().cast("double")), 3).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))), 3).alias("mrr"), *more)


def refusal_report(rows: DataFrame, threshold: float) -> DataFrame:
    """One row from (confidence, in_scope): rates, and a threshold between the two sets if they can be separated."""
    low, inside = F.col("confidence") < threshold, F.col("in_scope")
    out = rows.agg(
        F.avg(F.when(inside, low.cast("double"))).alias("false_refusal_rate"),
        F.avg(F.when(~inside, low.cast("double"))).alias("refusal_rate"),
        F.min(F.when(inside, F.col("confidence"))).alias("lowest_in"),
        F.max(F.when(~inside, F.col("confidence"))).alias("highest_out"),
    )
    apart = F.col("highest_out") < F.col("lowest_in")
    return out.withColumns({"separable": apart, "suggested": F.when(apart, (F.col("highest_out") + F.col("lowest_in")) / 2)})


def balance_status(balance: Column) -> tuple[Column, Column]:
    """Status and amount due: a negative balance is owed."""
    return F.when(balance < 0, "due").otherwise("settled"), F.when(balance < 0, F.round(F.abs(balance), 2)).otherwise(0.0)
