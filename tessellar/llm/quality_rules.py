"""Quality rules whose cut-offs follow the corpus: quantile sketches per language and source.

Every text is measured with built-in functions only. A measure is an integer ratio, and a group's sketch counts its values in bins that
are exact below 64 and a 32nd of the value wide above: a quantile is off by 3 % at most, a sketch has a few hundred rows however
large the group, and sketches of two sets of rows merge by adding counts. Partial sums are formed before the shuffle, and a
language's sketch is the merge of its sources'.

A group's cut-off is the larger of two figures: what its middle half allows (q75 + spread * (q75 - q25)), and what its tail shows
(`tail` times its q99.5). The tail's figure is held between `least` and `most_tail`, the only fixed numbers: a tail shorter than
`least` rejects nothing that is common elsewhere, and one longer than `most_tail` is taken for junk. So a group whose texts are all alike in a measure gets a narrow limit,
and one in which they vary a wide one. A group with too few rows takes its language's cut-offs, and that failing the corpus's; no group's
cut-off exceeds `most` times the corpus's, so that a source full of junk doesn't set a limit that lets its junk pass.

Defined results: null text has no words and fails the base rule; null language or source is a group of its
own; repeated rows and ids are judged row by row; an empty table gives an empty table; columns beside doc_id,
text, lang and source pass through untouched (measures replace input columns of the same name).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, materialize

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RATIOS = {
    "r_symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "r_dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "r_repeat": "1000 * n_repeat_words div greatest(n_words, 1)",
    "r_length": "100 * word_chars div greatest(n_words, 1)",
    "r_upper": "1000 * n_upper div greatest(word_chars, 1)",
    "r_shout": "1000 * n_shout div greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Rules:
    """least and most_tail are in steps of the ratios."""

    spread: float = 6.0
    tail: float = 2.0
    least: dict = field(default_factory=lambda: {"r_symbols": 30, "r_dup_lines": 200, "r_repeat": 150, "r_length": 0, "r_upper": 60, "r_shout": 30})
    most_tail: dict = field(default_factory=lambda: {"r_symbols": 150, "r_dup_lines": 500, "r_repeat": 350, "r_length": 0, "r_upper": 300, "r_shout": 300})
    most: float = 4.0
    least_rows: int = 100
    broadcast_groups: int = 20_000


def _bin(value: str) -> str:
    """SQL for the largest value of a value's bin: its first six binary digits name the bin."""
    width = f"greatest(length(bin({value})) - 6, 0)"
    return f"shiftleft(shiftright({value}, {width}) + 1, {width}) - 1"


def measures(text: Column) -> dict[str, Column]:
    """The counts of one text, by name; null counts as an empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {"_text": text, "_words": words, "_lines": lines}


def with_metrics(docs: DataFrame) -> DataFrame:
    """docs with the counts of METRICS and the ratios that the sketches summarise."""
    first = measures(F.col("text"))
    out = docs.withColumns(first)
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long"),
            "n_shout": F.length(F.regexp_replace("_text", r"[^!]+", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            # one 64-bit hash per window of three words; most texts repeat none and stop at the comparison of sizes
            "_windows": F.expr("case when size(_words) >= 3 then transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) else cast(array() as array<bigint>) end"),
        }
    )
    out = out.withColumn("_pairs", F.expr("case when size(array_distinct(_windows)) < size(_windows) then sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))) else cast(array() as array<struct<h:bigint,i:int>>) end"))
    repeated = "filter(_pairs, (p, j) -> (j > 0 and _pairs[j - 1].h = p.h) or (j < size(_pairs) - 1 and _pairs[j + 1].h = p.h))"
    out = out.withColumn("n_repeat_words", F.expr(f"cast(size(array_distinct(flatten(transform({repeated}, p -> array(p.i, p.i + 1, p.i + 2))))) as bigint)"))
    out = out.withColumns({k: F.expr(v) for k, v in _RATIOS.items()})
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("_text", "_words", "_lines", "_windows", "_pairs")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): the counts of each bin (by its largest value), for each group, each language (source null, level 1) and all rows (level 2)."""
    pairs = ", ".join(f"'{k}', {k}" for k in _RATIOS)
    long = measured.filter(~F.col("base_failed")).selectExpr("lang", "source", f"stack({len(_RATIOS)}, {pairs}) as (measure, value)")
    long = long.withColumn("value", F.expr(_bin("value")))
    base = long.groupBy("lang", "source", "measure", "value").agg(F.count("*").alias("n"))
    level1 = base.groupBy("lang", "measure", "value").agg(F.sum("n").alias("n"))
    level2 = level1.groupBy("measure", "value").agg(F.sum("n").alias("n"))
    return (
        base.withColumn("level", F.lit(0))
        .unionByName(level1.withColumns({"source": F.lit(None).cast("string"), "level": F.lit(1)}))
        .unionByName(level2.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "level": F.lit(2)}))
    )


def cutoffs(sketch: DataFrame, rules: Rules) -> DataFrame:
    """One row for each group, language and the corpus: a map from measure to cut-off, and the rows behind it."""
    at = Window.partitionBy("level", "lang", "source", "measure")
    ranked = sketch.withColumns({"upto": F.sum("n").over(at.orderBy("value")), "rows": F.sum("n").over(at)})
    quantile = lambda num, den: F.min(F.when(F.col("upto") * den >= F.col("rows") * num, F.col("value")))
    one = ranked.groupBy("level", "lang", "source", "measure").agg(quantile(1, 4).alias("q25"), quantile(3, 4).alias("q75"), quantile(199, 200).alias("q995"), F.max("rows").alias("rows"))
    bound = lambda by: F.create_map(*[F.lit(x) for kv in by.items() for x in kv])[F.col("measure")]
    middle = F.col("q75") + F.lit(rules.spread) * (F.col("q75") - F.col("q25"))
    limit = F.greatest(middle, F.greatest(bound(rules.least), F.least(F.lit(rules.tail) * F.col("q995"), bound(rules.most_tail))))
    return one.withColumn("limit", limit).groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("measure") == k, F.col("limit"))).alias(f"limit_{k}") for k in _RATIOS])


def judge(measured: DataFrame, limits: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """measured with kept: false where the base rule fails or a measure lies above its group's cut-off."""
    names = [f"limit_{k}" for k in _RATIOS]
    packed = limits.filter(F.col("level") < 2).filter(F.col("rows") >= rules.least_rows).select(F.col("level"), F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct(*names).alias("_limits"))
    overall = limits.filter("level = 2").select(F.struct(*names).alias("_all"))
    group = packed.filter("level = 0").drop("level").withColumnRenamed("_limits", "_g0")
    lang = packed.filter("level = 1").select(F.col("_l").alias("_l1"), F.col("_limits").alias("_g1"))
    few = limits.count() <= rules.broadcast_groups  # beyond this size both joins shuffle the measures instead
    hint = F.broadcast if few else (lambda x: x)
    out = measured.join(hint(group), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    out = out.join(hint(lang), F.col("lang").eqNullSafe(F.col("_l1")), "left")
    out = out.withColumn("_corpus", overall.scalar()).withColumn("_limit", F.coalesce("_g0", "_g1", "_corpus"))
    above = F.lit(False)
    for k in _RATIOS:
        limit = F.least(F.col(f"_limit.limit_{k}"), F.lit(rules.most) * F.col(f"_corpus.limit_{k}"))
        above = above | F.coalesce(F.col(k) > limit, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~above).drop("_l", "_s", "_g0", "_l1", "_g1", "_limit", "_corpus")


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with their measures, base_failed and kept.

    The measured rows are written once: the sketches and the verdicts read the same figures, and no filter on a verdict is
    pushed into the expressions behind it.
    """
    measured = materialize(with_metrics(docs), "measured")
    return judge(measured, materialize(cutoffs(sketches(measured), rules), "limits"), rules)
