"""Guardrails and personal data as column expressions generated from tables of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from . import text as text_of


def verdict(text: Column, longest: int = 4000) -> Column:
    """Name of the first rule that a text breaks, in order; null if none."""
    out = F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$"), "empty_input").when(F.length(text) > longest, "input_too_long")
    for name, pattern in fixed.GUARDRAIL_RULES:
        out = out.when(text.rlike("(?iU)" + pattern), name)
    return out


def leaks(text: Column, personas: tuple[str, ...] = ()) -> Column:
    """Whether an answer shows template marks or one of the given persona sentences."""
    out = text.rlike(fixed.LEAK_PATTERN)
    for p in personas:
        out = out | F.lower(text).contains(p.lower())
    return out


def matches(text: Column, label: str) -> Column:
    """All matches of a kind of personal data; cards must pass the Luhn test."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)) for name, p in fixed.PERSONAL if name == label]))
    if label == "CARD":
        found = F.filter(found, lambda x: F.call_function("luhn_check", F.regexp_replace(x, r"[^0-9]", "")))
    return found


def _valid(label: str, value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, r"[^0-9]", "")) if label == "CARD" else F.lit(True)


def _held(mapping: Column, value: Column) -> Column:
    """The placeholder that a mapping has for a value, or null."""
    return F.get(F.map_keys(F.map_filter(mapping, lambda _, v: v == value)), F.lit(0))


def _one_kind(state: Column, label: str, pattern: str) -> Column:
    """struct(text, mapping) after one kind: the text is cut at the matches, and each is put back as its placeholder."""
    regex = "(?U)" + pattern

    def replaced(hits: Column) -> Column:
        fresh = F.array_distinct(F.filter(hits, lambda v: _valid(label, v) & _held(state["mapping"], v).isNull()))
        used = F.transform(F.map_keys(state["mapping"]), lambda k: F.coalesce(F.nullif(F.regexp_extract(k, f"^<PII_{label}_([0-9]+)>$", 1), F.lit("")), F.lit("0")).cast("int"))
        numbered = text_of.bound(
            F.coalesce(F.array_max(used), F.lit(0)),
            lambda last: F.map_from_entries(F.transform(fresh, lambda v, i: F.struct(F.concat(F.lit(f"<PII_{label}_"), (last + i + 1).cast("string"), F.lit(">")), v))),
        )

        def told(mapping: Column) -> Column:
            put = lambda v: F.when(_valid(label, v), _held(mapping, v)).otherwise(v)
            parts = F.transform(F.split(state["text"], regex, -1), lambda x, i: F.when(i < F.size(hits), F.concat(x, put(F.get(hits, i)))).otherwise(x))
            return F.struct(F.array_join(parts, "").alias("text"), mapping.alias("mapping"))

        return F.when(F.size(hits) == 0, state).otherwise(text_of.bound(F.map_concat(state["mapping"], numbered), told))

    return text_of.bound(F.regexp_extract_all(state["text"], F.lit(regex), F.lit(0)), replaced)


def masked(text: Column, seed: Column | None = None) -> Column:
    """struct(text, mapping): personal data as numbered placeholders, kinds in declared order on the text masked so far.

    A value has one placeholder wherever it occurs. `seed` is the mapping of an earlier call: its values keep their
    placeholders and the numbers go on from it. Null and empty texts become empty.
    """
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), (F.expr("cast(map() as map<string,string>)") if seed is None else seed).alias("mapping"))
    return reduce(lambda state, kind: text_of.bound(state, lambda s: _one_kind(s, *kind)), fixed.PERSONAL, start)


def mask(text: Column) -> Column:
    """The masked text alone, for whatever is kept (traces, logs, tickets); null stays null."""
    return F.when(text.isNotNull(), masked(text)["text"])


def unmask(text: Column, mapping: Column) -> Column:
    """Placeholders back to their values, for display only."""
    return F.aggregate(F.map_entries(mapping), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def contains_placeholder(text: Column) -> Column:
    return text.rlike(fixed.PLACEHOLDER)


def kinds_found(mapping: Column) -> Column:
    """The kinds in a mapping, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.map_keys(mapping), lambda k: F.regexp_extract(k, "^<PII_([A-Z]+)_", 1))))


def masked_passages(rows: DataFrame, by: str, order: str, own: Column, fields: list[str], seed: Column | None = None) -> DataFrame:
    """rows with `fields` masked where `own` holds, and `mapping`: one numbering runs through the rows of each `by` in their order.

    For the few passages of an answer: the rows of one `by` are gathered. Rows outside `own` stay as they are.
    """
    empty = F.expr("cast(map() as map<string,string>)")
    every = F.struct(F.col(order).alias("_at"), own.alias("_own"), F.struct("*").alias("_row"))
    start = F.first(seed) if seed is not None else empty
    gathered = rows.groupBy(by).agg(F.array_sort(F.collect_list(every)).alias("_rows"), start.alias("_seed"))

    def one(state: Column, x: Column) -> Column:
        here = F.when(x["hide"], masked(x["text"], state["mapping"])).otherwise(F.struct(x["text"].alias("text"), state["mapping"].alias("mapping")))
        return text_of.bound(here, lambda m: F.struct(m["mapping"].alias("mapping"), F.concat(state["out"], F.array(m["text"])).alias("out")))

    # all fields of all rows in one array, so that one fold numbers them
    each = F.transform("_rows", lambda x: F.array(*[F.struct((x["_own"] & x["_row"][f].isNotNull()).alias("hide"), x["_row"][f].alias("text")) for f in fields]))
    start = F.struct(F.col("_seed").alias("mapping"), F.expr("cast(array() as array<string>)").alias("out"))
    folded = gathered.withColumn("_each", F.flatten(each)).withColumn("_done", F.aggregate("_each", start, one))
    out = folded.select(F.col("_done.mapping").alias("mapping"), F.col("_done.out").alias("_new"), F.posexplode("_rows").alias("_i", "_x"))
    at = lambda c: F.get("_new", F.col("_i") * len(fields) + fields.index(c))
    return out.select(*[(at(c) if c in fields else F.col(f"_x._row.{c}")).alias(c) for c in rows.columns], "mapping")


def spurious(text: Column) -> Column:
    """Whether a transcript is filler, an artefact of subtitles, or a decoding loop; a blank one is none of these."""
    norm = text_of.normalize(F.lower(F.trim(text)))

    def artefact(t: Column) -> Column:
        out = F.lit(False)
        for a in fixed.ARTIFACTS:
            folded = a.translate(str.maketrans(fixed.LETTERS_FROM, fixed.LETTERS_TO))
            out = out | (t == folded) | (t.contains(folded) & (F.length(t) < len(folded) * 2.5))
        return out

    def loops(tokens: Column) -> Column:
        n = F.size(tokens)

        def loop(size: int) -> Column:
            grams = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(size)), " "))
            most = F.array_max(F.transform(text_of.histogram(grams), lambda g: g["n"]))
            return (n >= max(6, 3 * size)) & (most * size >= 0.6 * n)

        return reduce(lambda a, b: a | b, map(loop, (1, 2, 3, 4)))

    return F.when(text.rlike(r"(?U)^\s*$"), False).otherwise(text.rlike("(?U)" + fixed.FILLER) | (F.length(norm) < 2) | text_of.bound(norm, artefact) | text_of.bound(text_of.words(text), loops))


def transcript(text: Column) -> Column:
    """struct(text, spurious): the trimmed transcript, empty where it is spurious or blank."""
    bad = F.coalesce(spurious(text), F.lit(False))
    return text_of.bound(bad, lambda b: F.struct(F.when(b, "").otherwise(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")).alias("text"), b.alias("spurious")))


def needs_clarification(text: Column, confidence: Column) -> Column:
    """Whether to ask again: nothing was heard, or too uncertainly."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$") | (confidence < fixed.LEAST_SPEECH)


def speech_confidence(segments: Column) -> Column:
    """Mean of exp(avg_logprob) weighted by duration (0.01 s at least), from an array of struct(start, end, avg_logprob); 0 for none."""
    long = lambda x: F.greatest(x["end"] - x["start"], F.lit(0.01))
    add = lambda f: F.aggregate(segments, F.lit(0.0), lambda a, x: a + f(x))
    mean = add(lambda x: F.exp(F.coalesce(x["avg_logprob"], F.lit(-1.0))) * long(x)) / F.greatest(add(long), F.lit(0.01))
    return F.when(F.size(segments) > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), 3)).otherwise(0.0)
