"""Hard negatives against a brute-force version."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("tessellar.llm.queries")
from pyspark.sql import functions as F

from tessellar.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string, rank string"


def brute(rows, step=100, p=hard_negatives.Mining()):
    sound = [(i, label, [math.floor(p.scale * float(np.float32(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, label, v in sorted(sound, key=lambda r: (r[1], r[2])):
        if i % step == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for i, (label, v) in anchors.items():
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in sound if j != i), key=lambda r: (-r[0], r[1]))
        for s, j, _ in [r for r in scored if r[2] == label][: p.positives]:
            fit = [(t, k) for t, k, other in scored if other != label and p.percent * s <= 100 * t <= 100 * s][: p.negatives]
            out += [(i, j, n, k, s, t) for n, (t, k) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, parts=3, **more):
    frame = spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("id") % 100 == 0, **more).collect())


def table(seed, n, dims=6, grain=4):
    """Few distinct values, so that ties and equal rows are many."""
    rng = random.Random(seed)
    return [(i, [rng.randint(-grain, grain) / grain for _ in range(dims)], rng.randint(0, 2)) for i in range(n)]


def test_equals_brute_force_with_ties_and_repeated_rows(spark):
    rows = table(1, 700)
    rows += rows[90:130] + [(5, [1.0] * 6, 1), (5, [0.5] * 6, 2), (200, [1.0] * 6, 0)]
    rows += [(1000 + i, [1.0] * 6, 1) for i in range(150)]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    small = hard_negatives.Mining(block=2)
    assert mined(spark, rows, p=small) == want


def test_rows_that_take_no_part(spark):
    rows = table(2, 300)
    odd = [(None, [1.0] * 6, 0), (400, None, 0), (500, [1.0] * 6, None), (600, [math.nan] + [1.0] * 5, 1), (601, [math.inf] + [1.0] * 5, 1), (602, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1)]
    assert mined(spark, rows + odd) == brute(rows)
    assert mined(spark, odd) == [] and mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [2.0], 0)]) == []


def test_lengths_and_large_products(spark):
    rows = [(0, [2.0, 1.0], 1), (1, [2.0], 1), (2, [1.0, 1.0, 9.0], 1), (3, [2.0, 0.5], 2), (4, [], 2), (5, [1.75], 2)]
    assert mined(spark, rows) == brute(rows)
    # sums beyond 2**53, where doubles would round
    big = [(0, [2.0**18, 1.0], 1), (1, [2.0**20, 3 / 256], 1), (2, [2.0**20, 2 / 256], 2), (3, [2.0**20, 1 / 256], 2), (4, [2.0**20, 4 / 256], 2)]
    assert mined(spark, big) == brute(big) and [r[3] for r in mined(spark, big)] == [2, 3]
    beyond = [(i, [1e30, 1.0], i % 2) for i in range(4)]
    assert all(r[4] == r[5] == 2**63 - 1 for r in mined(spark, beyond)) and len(mined(spark, beyond)) == 2
