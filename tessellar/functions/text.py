"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, however often it occurs there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def compatible(text: Column) -> Column:
    """Unicode's compatibility composition (NFKC), for which Spark has no function: an Arrow-batched one."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return run(text)


def normalize(text: Column, fold_letters: bool = True, nfkc: bool = False) -> Column:
    """Orthographic folding: diacritics and tatweel go, digits become ASCII, letter variants fold, white space collapses; NFKC first if asked for."""
    t = F.regexp_replace(compatible(text) if nfkc else text, fixed.DIACRITICS, "")
    t = F.translate(F.replace(t, F.lit(fixed.TATWEEL), F.lit("")), fixed.DIGITS_FROM, fixed.DIGITS_TO)
    if fold_letters:
        t = F.translate(t, fixed.LETTERS_FROM, fixed.LETTERS_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(t, fixed.ZERO_WIDTH, ""), r"\s+", " "))


def tokens(text: Column, stem: bool = False) -> Column:
    """Lower-case folded tokens; an index and its queries stem both or neither."""
    plain = F.regexp_extract_all(normalize(F.lower(text)), F.lit(r"[\p{L}\p{N}_؀-ۿ]+"), F.lit(0))
    return F.when(text.rlike(fixed.ARABIC), F.transform(plain, light_stem)).otherwise(plain) if stem else plain


def words(text: Column) -> Column:
    """What white space separates in the folded lower-case text."""
    return F.array_remove(F.split(normalize(F.lower(text)), " "), "")


def histogram(items: Column) -> Column:
    """(item, n) of an array's elements, in one pass over the sorted array."""

    def starts(a: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        return bound(first, lambda f: F.transform(f, lambda p, k: F.struct(F.get(a, p).alias("item"), (F.coalesce(F.get(f, k + 1), F.size(a)) - p).cast("long").alias("n"))))

    return bound(F.array_sort(items), lambda a: F.when(F.size(a) > 0, starts(a)).otherwise(F.expr("cast(array() as array<struct<item:string,n:bigint>>)")))


def light_stem(token: Column) -> Column:
    """One prefix, one suffix, one verb prefix of Arabic tokens, each only if three characters remain."""

    def strip(t: Column, affixes: list[str], front: bool) -> Column:
        out = t
        for a in reversed(affixes):
            fits = (t.startswith(a) if front else t.endswith(a)) & (F.length(t) - len(a) >= 3)
            cut = F.substring(t, F.lit(len(a) + 1), F.length(t)) if front else F.substring(t, F.lit(1), F.length(t) - len(a))
            out = F.when(fits, cut).otherwise(out)
        return out

    rest = lambda t: bound(strip(t, fixed.STEM_SUFFIXES, False), lambda u: strip(u, fixed.STEM_VERB_PREFIXES, True))
    return F.when(token.rlike(fixed.ARABIC), bound(strip(token, fixed.STEM_PREFIXES, True), rest)).otherwise(token)


def script_counts(text: Column) -> tuple[Column, Column]:
    """Characters in the Arabic blocks and in A-Z, a-z."""
    return F.length(F.regexp_replace(text, fixed.ARABIC.replace("[", "[^"), "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def language(text: Column) -> Column:
    """ar, arz, en, mixed or unknown, by script shares and dialect words."""
    arabic, latin = script_counts(text)
    total = F.greatest(arabic + latin, F.lit(1))
    dialect = F.arrays_overlap(tokens(text), F.array(*[F.lit(w) for w in fixed.DIALECT_WORDS + fixed.LATIN_DIALECT_WORDS]))
    return (
        F.when((F.trim(F.coalesce(text, F.lit(""))) == "") | (arabic + latin == 0), "unknown")
        .when((arabic / total >= 0.15) & (latin / total >= 0.15), "mixed")
        .when(arabic > latin, F.when(dialect, "arz").otherwise("ar"))
        .otherwise(F.when(dialect, "arz").otherwise("en"))
    )


def is_arabic(language: Column) -> Column:
    return language.isin("ar", "arz", "mixed")


def answer_language(language: Column) -> Column:
    """The language to answer in: English for English, Arabic for all else."""
    return F.when(language == "en", "en").otherwise("ar")


def truncate_at(text: Column, stops: list[str]) -> Column:
    """What stands before the first of the stop tokens, trimmed."""
    return F.trim(reduce(lambda t, stop: F.substring_index(t, stop, 1), stops, text))


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table; short rows are filled with empty cells, the first row is the header."""
    width = F.array_max(F.transform(rows, F.size))

    def drawn(w: Column) -> Column:
        line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        body = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))))
        return F.array_join(F.concat(F.slice(body, 1, 1), F.array(line(F.array_repeat(F.lit("---"), w))), F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))), "\n")

    return F.when(F.size(rows) > 0, bound(width, drawn)).otherwise("")


def estimate_tokens(text: Column) -> Column:
    arabic, latin = script_counts(text)
    share = F.when(arabic + latin > 0, arabic / (arabic + latin)).otherwise(0.0)
    return F.when(F.length(text) == 0, 0).otherwise((F.length(text) / F.greatest(2.6 * share + 4.0 * (1 - share), F.lit(1.0))).cast("int") + 1).cast("int")


def chunk_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.encode(F.concat_ws("||", *parts), "UTF-8")), 1, 20)


def is_heading(line: Column) -> Column:
    words = F.size(F.array_remove(F.split(line, r"\s+"), ""))
    return line.startswith("#") | ((F.length(line) <= 70) & (words <= 8) & ~line.rlike("[.،؟!:?]$"))


def snippet(text: Column, width: int = 220) -> Column:
    """At most `width` characters, cut at a word."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(F.substring(t, 1, width), "^(.*) ", 1), F.lit("")), F.substring(t, 1, width)), F.lit("…")))


def fingerprint(text: Column) -> Column:
    """Sampled 12-token shingles; null for exactly 12 tokens, which are never a duplicate."""

    def printed(t: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(0), F.size(t) - 13, F.lit(48)), lambda i: F.array_join(F.slice(t, i + 1, F.lit(12)), " "))
        return F.when(F.size(t) < 12, F.array(F.array_join(t, " "))).when(F.size(t) > 12, F.array_sort(F.array_distinct(shingles)))

    return bound(F.array_remove(F.split(normalize(text), " "), ""), printed)  # the text is folded and split once, not once a shingle


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def count_contained(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(n).cast("int") for n in needles])


def count_folded(folded: Column, needles: list[str]) -> Column:
    """How many needles a folded text holds, each folded likewise by Spark (constants of the plan)."""
    return reduce(lambda a, b: a + b, [folded.contains(normalize(F.lit(n))).cast("int") for n in needles])


def speakable(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[\d{1,2}\]", ""), r"https?://\S+", ""), r"[*_`#|]+", " ")
    return F.substring(F.trim(F.regexp_replace(F.split(t, r"\n\s*(?:المصادر|Sources)\s*:")[0], r"\s+", " ")), 1, 1200)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def nearest_rank(sorted_values: Column, percent: float) -> Column:
    """The value at clamp(round_half_even(percent / 100 * n + 0.5) - 1) of a sorted array; null for none."""
    n = F.size(sorted_values)
    at = F.greatest(F.lit(0), F.least(n - 1, (F.rint(F.lit(percent / 100) * n + 0.5) - 1).cast("int")))
    return F.when(n > 0, F.get(sorted_values, at))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character error rate; 0 for an empty reference."""
    return F.when(F.length(reference) > 0, F.levenshtein(reference, hypothesis) / F.length(reference)).otherwise(0.0)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word error rate; 0 for an empty reference. Each distinct word of the pair becomes one code point above the basic plane."""
    words = lambda t: F.filter(F.split(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), " "), lambda w: w != "")
    a, b = words(reference), words(hypothesis)
    known = F.array_distinct(F.concat(a, b))
    point = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x10000), 8, "0")), "UTF-32")
    mapped = [F.array_join(F.transform(x, point), "") for x in (a, b)]
    return F.when(F.size(a) > 0, F.levenshtein(*mapped) / F.size(a)).when(reference.isNotNull() & hypothesis.isNotNull(), 0.0)
