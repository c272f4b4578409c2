"""Measures over turn records, of sessions, stages and speech recognition, and checks of evaluation sets.

A turn record has: turn_no, session_id, input_mode, language, intent, asr_confidence, question, grounded, handed_off, blocked,
executed (null: no action), resolution, and the stages' times in milliseconds with total_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import insights


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def total_ms(stages: list[str] | None = None) -> Column:
    """The sum of a row's stages, absent ones as 0, to 1 decimal."""
    out = F.lit(0.0)
    for s in stages or fixed.STAGES:
        out = out + F.coalesce(s, F.lit(0.0))
    return F.round(out, 1)


def laps(marks: DataFrame, by: str, at: str) -> DataFrame:
    """marks with `lap_ms`: the time since the mark before, to 1 decimal; null for the first."""
    before = F.lag(F.unix_micros(at)).over(Window.partitionBy(by).orderBy(at))
    return marks.withColumn("lap_ms", F.round((F.unix_micros(at) - before) / 1000, 1))


def summary(turns: DataFrame) -> DataFrame:
    """One row: turns, voice_turns, text_turns, grounded_rate, escalation_rate, blocked_turns, actions_executed, actions_refused, avg_total_ms, p95_total_ms and the mean of each stage where it was measured. Zeros for no turns."""
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 3)
    stages = [F.round(F.avg(s), 1).alias(f"avg_{s}") for s in fixed.STAGES]
    one = turns.agg(
        F.count("*").alias("turns"),
        count_if(F.col("input_mode") == "voice").alias("voice_turns"),
        count_if(F.col("input_mode") == "text").alias("text_turns"),
        share(F.col("grounded")).alias("grounded_rate"),
        share(F.col("handed_off")).alias("escalation_rate"),
        count_if(F.col("blocked")).alias("blocked_turns"),
        count_if(F.col("executed")).alias("actions_executed"),
        count_if(~F.col("executed")).alias("actions_refused"),
        F.round(F.coalesce(F.avg(F.when(F.col("total_ms") > 0, F.col("total_ms"))), F.lit(0.0)), 1).alias("avg_total_ms"),
        *stages,
    )
    timed = turns.filter("total_ms > 0").select(F.lit(0).alias("g"), "total_ms")
    p95 = insights.percentile_table(timed, ["g"], "total_ms", [95]).agg(F.max("p95").alias("p")).scalar()
    return one.withColumn("p95_total_ms", F.round(F.coalesce(p95, F.lit(0.0)), 1))


def unanswered(turns: DataFrame, order: str = "turn_no", most: int = 10) -> DataFrame:
    """The last `most` questions that the answers did not cover, in their order."""
    rows = turns.filter(F.col("resolution").isin("no_answer", "refused") & (F.coalesce("question", F.lit("")) != ""))
    return rows.orderBy(F.desc(order)).limit(most).orderBy(order)


def stage_samples(turns: DataFrame, order: list[str], most: int = fixed.SAMPLES) -> DataFrame:
    """(stage, ms): each stage's last samples that are neither absent nor 0, `total` among them."""
    names = ["total_ms", *fixed.STAGES]
    pairs = F.explode(F.array(*[F.struct(F.lit(s.removesuffix("_ms")).alias("stage"), F.col(s).cast("double").alias("ms")) for s in names]))
    each = turns.select(*order, pairs.alias("x")).select(*order, "x.*").filter(F.coalesce("ms", F.lit(0.0)) != 0)
    return insights.sample_window(each, "stage", order, most).select("stage", "ms")


def stage_stats(samples: DataFrame) -> DataFrame:
    """(stage, n, mean_ms, p50_ms, p95_ms, max_ms) of samples, to 1 decimal."""
    ranked = insights.percentile_table(samples, ["stage"], "ms", [50, 95]).select("stage", F.round("p50", 1).alias("p50_ms"), F.round("p95", 1).alias("p95_ms"))
    plain = samples.groupBy("stage").agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 1).alias("mean_ms"), F.round(F.max("ms"), 1).alias("max_ms"))
    return plain.join(ranked, "stage").select("stage", "n", "mean_ms", "p50_ms", "p95_ms", "max_ms")


def session_metrics(turns: DataFrame, speech: DataFrame | None = None) -> DataFrame:
    """One row a session: counts, mean_asr_confidence of voice turns (null for none), grounded_rate, and the counts of speech (session_id, filtered, clarified) if given."""
    voice = F.col("input_mode") == "voice"
    out = turns.groupBy("session_id").agg(
        F.count("*").alias("turns"),
        count_if(voice).alias("voice_turns"),
        F.round(F.avg(F.when(voice, F.col("asr_confidence"))), 3).alias("mean_asr_confidence"),
        F.round(F.avg(F.col("grounded").cast("double")), 3).alias("grounded_rate"),
        count_if(F.col("resolution") == "refused").alias("refused"),
        count_if(F.col("blocked")).alias("blocked"),
        count_if(F.col("handed_off")).alias("escalated"),
        count_if(F.col("executed")).alias("actions_executed"),
        count_if(~F.col("executed")).alias("actions_refused"),
    )
    if speech is None:
        return out
    heard = speech.groupBy("session_id").agg(count_if(F.col("filtered")).alias("filtered"), count_if(F.col("clarified")).alias("clarified"))
    return out.join(heard, "session_id", "full_outer").na.fill(0, [c for c in out.columns if c not in ("session_id", "mean_asr_confidence")] + ["filtered", "clarified"])


def registry(turns: DataFrame, wer: DataFrame | None = None) -> DataFrame:
    """One row over all sessions: sessions_tracked, turns, voice_turns, guardrail_blocks, escalations, and n and mean (4 decimals, null for none) of word error rates."""
    one = turns.agg(F.count_distinct("session_id").alias("sessions_tracked"), F.count("*").alias("turns"), count_if(F.col("input_mode") == "voice").alias("voice_turns"), count_if(F.col("blocked")).alias("guardrail_blocks"), count_if(F.col("handed_off")).alias("escalations"))
    if wer is None:
        return one.withColumns({"wer_n": F.lit(0).cast("long"), "wer_mean": F.lit(None).cast("double")})
    rates = wer.agg(F.count("wer").alias("n"), F.round(F.avg("wer"), 4).alias("mean"))
    return one.withColumns({"wer_n": rates.select("n").scalar(), "wer_mean": rates.select("mean").scalar()})


def confidence_summary(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, min, p5, median, p95, max) of `confidence`, to 3 decimals; the median is interpolated."""
    ranked = insights.percentile_table(rows, [by], "confidence", [5, 95])
    plain = rows.groupBy(by).agg(F.min("confidence").alias("min"), F.median("confidence").alias("median"), F.max("confidence").alias("max"))
    return plain.join(ranked, by).select(by, "n", *[F.round(c, 3).alias(c) for c in ("min", "p5", "median", "p95", "max")])


def crawl_stats(pages: DataFrame) -> DataFrame:
    """(outcome, n)."""
    return pages.groupBy("outcome").agg(F.count("*").alias("n"))


def speech_report(rows: DataFrame) -> DataFrame:
    """(condition, dialect, n, wer, wer_normalised, cer_normalised, mean_rtf, filtered, clarified): overall (both null), by condition and by dialect, absent values left out."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c)
    return rows.groupingSets([[], ["condition"], ["dialect"]], "condition", "dialect").agg(
        F.count("*").alias("n"), mean("wer"), mean("wer_normalised"), mean("cer_normalised"), F.round(F.coalesce(F.avg("rtf"), F.lit(0.0)), 4).alias("mean_rtf"), count_if(F.col("filtered")).alias("filtered"), count_if(F.col("clarified")).alias("clarified")
    )


def real_time_factor(took: Column, duration: Column) -> Column:
    """Time taken by a second of sound, to 2 decimals; null without sound."""
    return F.when(duration != 0, F.round(took / duration, 2))


def manifest_problems(items: DataFrame, files: DataFrame) -> DataFrame:
    """(item, problem) of a manifest (item, audio, reference, dialect, condition) against the files (audio) there are; nothing for a sound one."""
    label = F.coalesce("audio", F.concat(F.lit("entry "), F.col("item").cast("string")))
    held = items.join(files.select("audio", F.lit(True).alias("_there")).distinct(), "audio", "left")
    missing = [F.when(F.col(c).isNull(), F.concat(label, F.lit(f"{fixed.MISSING_FIELD}'{c}'"))) for c in fixed.MANIFEST_FIELDS]
    absent = F.when((F.coalesce("audio", F.lit("")) != "") & F.col("_there").isNull(), F.concat(label, F.lit(fixed.MISSING_FILE)))
    empty = F.when(~F.col("condition").eqNullSafe("silence") & (F.trim(F.coalesce("reference", F.lit(""))) == ""), F.concat(label, F.lit(fixed.EMPTY_REFERENCE)))
    return held.select("item", F.explode(F.array_compact(F.array(*missing, absent, empty))).alias("problem"))


def uncovered(items: DataFrame) -> DataFrame:
    """(kind, value): the expected conditions and dialects that no row of a manifest has."""
    spark = items.sparkSession
    expected = spark.createDataFrame([("condition", c) for c in fixed.EXPECTED_CONDITIONS] + [("dialect", d) for d in fixed.EXPECTED_DIALECTS], "kind string, value string")
    seen = items.select(F.explode(F.array(F.struct(F.lit("condition").alias("kind"), F.col("condition").alias("value")), F.struct(F.lit("dialect").alias("kind"), F.col("dialect").alias("value")))).alias("x")).select("x.*").distinct()
    return expected.join(seen, ["kind", "value"], "left_anti")


def unlicensed(models: DataFrame, licences: DataFrame, commercial: list[str], unverified: list[str]) -> DataFrame:
    """The models (model) that no licence (model, licence) allows: absent, or neither commercial nor unverified and listed as such."""
    known = models.select("model").distinct().join(licences, "model", "left")
    fine = F.col("licence").isin(*commercial) | ((F.col("licence") == "unverified") & F.col("model").isin(*unverified))
    return known.filter(~F.coalesce(fine, F.lit(False)))


def any_fragment(url: Column, expected: Column) -> Column:
    """Whether a URL holds one of an array of fragments."""
    return F.exists(expected, lambda f: F.contains(url, f))


def compare_models(results: dict[str, DataFrame], commercial: dict[str, bool]) -> DataFrame:
    """(model, commercial, n, recall, mrr): the overall evaluation of several models' results (query, hit_rank), best recall first."""
    out = None
    for name, ranked in results.items():
        one = insights.recall_mrr(ranked.withColumn("_all", F.lit(1)), ["_all"]).filter("_all is null").drop("_all").select(F.lit(name).alias("model"), F.lit(commercial.get(name, False)).alias("commercial"), "n", "recall", "mrr")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("recall"), F.desc("mrr"), "model")


def markdown(one: dict, counts: dict[str, list[tuple[str, int]]], questions: list[str]) -> str:
    """A report in Markdown: a table of a collected summary row's measures, one of each list of counts, and the unanswered questions."""
    if not one["turns"]:
        return "No turns."
    shown = [(k.replace("_", " "), f"{v:.1%}" if k.endswith("_rate") else f"{v:g}") for k, v in one.items() if v is not None]
    parts = [[("measure", "value"), *shown], *[[(title, "turns"), *pairs] for title, pairs in counts.items() if pairs]]
    tables = ["\n".join([f"| {rows[0][0]} | {rows[0][1]} |", "| - | - |", *[f"| {k} | {v} |" for k, v in rows[1:]]]) for rows in parts]
    return "\n\n".join([*tables, *(["Unanswered:\n" + "\n".join(f"- {q}" for q in questions)] if questions else [])])
