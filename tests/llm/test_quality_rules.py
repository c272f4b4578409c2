"""Cut-offs that follow their groups, and the bins behind them."""

import random

import pytest

pytest.importorskip("tessellar.llm.queries")
from pyspark.sql import functions as F

from tessellar.llm import quality_rules as qr
from tessellar.llm.common import materialize

MEASURES = ["r_symbols", "r_dup_lines", "r_repeat", "r_length", "r_upper", "r_shout"]


def text(rng, kind):
    """Texts of one kind are alike in some measure: long words, capitals, exclamations, repeated lines, signs."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(8, 16) if kind == "long" else rng.randint(2, 7))) for _ in range(120)]
    if kind == "capitals":
        words = [w.upper() if rng.random() < 0.5 else w for w in words]
    if kind == "loud":
        words = [w + "!" * rng.choice([0, 0, 1, 1]) for w in words]
    if kind == "signs":
        words = [w + rng.choice(["", "", "", " #"]) for w in words]
    lines = [" ".join(words[i : i + 6]) for i in range(0, 120, 6)]
    if kind == "lists":
        lines = [lines[0] if rng.random() < 0.25 else x for x in lines]
    return "\n".join(lines)


def test_limits_move_with_the_group(spark):
    rng = random.Random(1)
    kinds = ["plain", "long", "capitals", "loud", "signs", "lists"]
    rows = [(i, text(rng, kinds[i % 6]), "en", kinds[i % 6]) for i in range(1200)]
    # a text of another kind stands out among plain ones, and not among its own
    rows += [(5000 + i, text(rng, k), "en", "plain") for i, k in enumerate(kinds)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = materialize(qr.with_metrics(frame), "measured")
    limits = {r.source: r for r in qr.cutoffs(qr.sketches(measured), qr.Rules()).filter("level = 0").collect()}
    moved = {m for m in MEASURES if len({limits[k][f"limit_{m}"] for k in kinds}) > 1}
    assert len(moved) >= 4 and limits["long"].limit_r_length > limits["plain"].limit_r_length and limits["capitals"].limit_r_upper > limits["plain"].limit_r_upper
    assert limits["signs"].limit_r_symbols > limits["plain"].limit_r_symbols and limits["loud"].limit_r_shout > limits["plain"].limit_r_shout
    kept = {r.doc_id: r.kept for r in qr.quality_rules(frame).select("doc_id", "kept").collect()}
    assert kept[5000] and not any(kept[5001 + i] for i in range(4))
    own = [kept[i] for i in range(1200) if kinds[i % 6] != "lists"]
    assert sum(own) >= 0.99 * len(own)


def test_bins_are_close_and_few(spark):
    values = [*range(200), 999, 1000, 12345, 2**30, 2**40 + 17]
    got = spark.createDataFrame([(v,) for v in values], "value long").select("value", F.expr(qr._bin("value")).alias("b")).collect()
    assert all(r.value <= r.b <= r.value * (1 + 1 / 32) for r in got) and all(r.b == r.value for r in got if r.value < 64)
    n = spark.range(100_000).selectExpr("id as value").select(F.expr(qr._bin("value")).alias("b")).distinct().count()
    assert n < 64 + 32 * 12


def test_sketches_merge(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, "plain"), "en" if i % 2 else None, f"s{i % 5}") for i in range(150)]
    measured = materialize(qr.with_metrics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "measured")
    told = lambda f, level: {(r.lang, r.source, r.measure, r.value): r.n for r in f.filter(F.col("level") == level).collect()}
    whole = qr.sketches(measured)
    parts = [told(qr.sketches(measured.filter(F.col("doc_id") % 3 == k)), 1) for k in range(3)]
    summed = {}
    for part in parts:
        for key, n in part.items():
            summed[key] = summed.get(key, 0) + n
    assert summed == told(whole, 1)
