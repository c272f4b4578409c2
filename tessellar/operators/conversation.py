"""Signals of conversations: recent questions, repeats, streaks, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


def recent_questions(turns: DataFrame, n: int = 4) -> DataFrame:
    """User turns with `previous`: the n user turns before."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.filter("role = 'user'").withColumn("previous", F.collect_list("text").over(w))


def with_repeats(turns: DataFrame) -> DataFrame:
    """recent_questions with `repeated`: Jaccard of token sets of at least 0.6 with one of them."""
    here = F.array_distinct(text.words(F.col("text")))
    q = recent_questions(turns).withColumn("tok", here)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    q = q.withColumn("ptok", F.collect_list("tok").over(w))
    return q.withColumn("repeated", F.exists("ptok", lambda p: text.jaccard(p, F.col("tok")) >= fixed.REPEAT)).drop("tok", "ptok")


def streak(flag: str, by: str = "conv_id", order: str = "turn") -> Column:
    """Length of the run of true flags that ends here. Needs `<flag>_island` from with_streak."""
    return F.row_number().over(Window.partitionBy(by, f"{flag}_island", flag).orderBy(order)) * F.col(flag).cast("int")


def with_streak(rows: DataFrame, flag: str) -> DataFrame:
    """rows with `<flag>_streak`, and `<flag>_before`: the streak as the turn found it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = rows.withColumn(f"{flag}_island", F.sum((~F.col(flag)).cast("int")).over(w)).withColumn(f"{flag}_streak", streak(flag).cast("int"))
    return out.drop(f"{flag}_island").withColumn(f"{flag}_before", F.coalesce(F.lag(f"{flag}_streak").over(w), F.lit(0)))


def frustration(t: Column, repeated: Column, repeat_streak: Column, low: Column, low_streak: Column, answered: Column) -> Column:
    """Unrounded score of a turn; an explicit wish for a human is 1."""
    arabic = text.bound(text.normalize(F.lower(t)), lambda n: text.count_folded(n, fixed.NEGATIVE_AR))
    negative = text.count_contained(F.lower(t), fixed.NEGATIVE_EN) + arabic
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    total = (
        F.least(0.2 * negative, F.lit(0.4)) + part(t.rlike("(?iU)" + fixed.PROFANITY), 0.15) + part(t.rlike(fixed.SHOUTING), 0.10)
        + part(repeated, 0.25) + part(repeat_streak >= 2, 0.20) + part(low, 0.15) + part(low_streak >= 2, 0.25) + part(~answered, 0.10)
    )
    wish = t.rlike("(?iU)" + fixed.HUMAN_NAMED) & t.rlike("(?iU)" + fixed.WISHED)
    return F.when(wish, 1.0).otherwise(F.least(total, F.lit(1.0)))


def escalate_once(scored: DataFrame) -> DataFrame:
    """The first turn of each conversation whose score calls for a human."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return scored.filter(F.col("score") >= fixed.HANDOFF).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def sessions(events: DataFrame, gap: int = fixed.TTL_SECONDS) -> DataFrame:
    """(user_id, session_no, started, ended, n): a gap of more than `gap` seconds starts a session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce((us - F.lag(us).over(w) > gap * 1_000_000).cast("int"), F.lit(1))
    out = events.withColumn("new", new).withColumn("session_no", F.sum("new").over(w))
    return out.groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def agent_available(ts: Column) -> Column:
    return ((F.hour(ts) + 2) % 24).between(9, 21)
