"""Collocations against a brute-force version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tessellar.llm.queries")
from tessellar.llm import collocations
from tessellar.llm.collocations import Mining

SCHEMA = "lang string, text string, phrase string, n string, a string, rank string"


def brute(rows, p=Mining()):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for s in range(1, p.longest + 1):
                f[lang].update(tuple(words[i : i + s]) for i in range(len(words) - s + 1))
    out = []
    for lang, of in f.items():
        candidates = {g: a for g, a in of.items() if len(g) > 1 and a >= p.least}
        longer = Counter()
        for g, a in candidates.items():
            for s in range(2, len(g)):
                for i in range(len(g) - s + 1):
                    longer[g[i : i + s]] = max(longer[g[i : i + s]], a)
        found = []
        for g, a in candidates.items():
            if 100 * longer[g] >= p.share * a and longer[g]:
                continue
            score, k = min((10**6 * a * a // (of[g[:k]] * of[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), of[g[:k]], of[g[k:]]))
        out += [(lang, i, phrase.decode(), -a, l, r, n[lang], -score) for i, (score, a, phrase, l, r) in enumerate(sorted(found)[: p.top], 1)]
    return sorted(out)


def mined(spark, rows, parts=3, **more):
    frame = spark.createDataFrame([(lang, text, "a", "b", "c", "d") for lang, text in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in collocations.mine(frame, **more).collect())


def prose(rng, n, kinds=40):
    words = [rng.choice(["A", "b", "É", "ü🎉", ""]) + "xy"[i % 2] + str(i) for i in range(kinds)]
    return "".join(rng.choice(words[: rng.randint(1, kinds)]) + rng.choice([" ", " ", "\t ", ", ", ".\n", "  "]) for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de", None, "und", ""]), prose(rng, rng.randint(0, 80))) for _ in range(700)]
    rows += rows[:25] + [("en", None), (None, ""), ("de", "new york city " * 30 + "New York. CITY"), ("en", ".;, \t\x0b"), ("fr", "one word")]
    want = brute(rows)
    assert mined(spark, rows) == want and len({r[0] for r in want}) >= 4 and any(r[2].count(" ") == 2 for r in want)
    for p in (Mining(top=7), Mining(longest=2, least=3), Mining(longest=4, least=4), Mining(share=90)):
        assert mined(spark, rows, p=p) == brute(rows, p)


def test_empty_tables(spark):
    assert mined(spark, [], 1) == [] and mined(spark, [(None, None)], 1) == []


def test_slices_of_a_very_long_text(spark):
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(200)}" for _ in range(1_100_000))
    assert len(text) > collocations.SLICE
    rows = [("en", text), ("en", text[:100] + "," + text[-100:])]
    assert mined(spark, rows) == brute(rows)


def test_full_buckets_only_cost_work(spark, monkeypatch):
    """With every bucket full nothing is ruled out by buckets, and the result is the same."""
    rng = random.Random(5)
    rows = [("en", prose(rng, 60)) for _ in range(100)]
    monkeypatch.setattr(collocations, "bitmap", lambda rows, bits, most: np.full((1 << bits) // 8, 255, np.uint8))
    assert mined(spark, rows) == brute(rows)


def test_counters_stop():
    buckets = collocations.Buckets(16, 10)
    buckets.add(np.array([5, 5, 5, 1 << 20 | 5, 7], np.uint64))
    assert buckets.counts[5] == 4 and buckets.counts[7] == 1
    buckets.add(np.full(1000, 5, np.uint64))
    assert buckets.counts[5] == 10
