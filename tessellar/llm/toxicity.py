"""Toxicity by non-negative positive-unlabelled learning.

A linear model learns from confirmed toxic texts and from unlabelled text. Its features are all stems (first six bytes of
lower-case words) of the whole text, and apart from those the stems that occur twice, and thrice, within any NEAR words
in a row, so that what is dense somewhere counts alike in a long text and a short one. Which stems tell nothing is left to
the training rows. With the class prior P, the risk of unlabelled text taken as clean is corrected for the toxic texts in
it, and the corrected part is kept from falling below zero:
    P * loss(toxic as toxic) + max(0, loss(unlabelled as clean) - P * loss(toxic as clean)).
Where the corrected part is negative, the step goes the other way along it. Weights shrink by an L1 term.

Training takes bounded samples (`positives`, `unlabelled`); scoring takes every row and every word. Null and empty
texts score by the offset alone; repeated rows score alike; an empty table gives no rows; without toxic rows every
score is 0; other columns pass through and `score` replaces a column of that name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .labelled import of_class, some, texts

#: Score of a text on the border.
CUT = 0.7
#: Words in a row within which a repeated stem is dense.
NEAR = 64
_TRIM = b".,;:!?\"'()"


def features(text: bytes) -> set[bytes]:
    """The stems of a text; those found twice or thrice within NEAR words end in one or two spaces."""
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(text.lower().split()):
        places.setdefault(w.strip(_TRIM)[:6], []).append(i)
    out = set(places)
    for stem, at in places.items():
        for k in (1, 2):
            if len(at) > k and any(b - a < NEAR for a, b in zip(at, at[k:], strict=False)):
                out.add(stem + b" " * k)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: list[bytes], unlabelled: list[bytes], prior: float, epochs: int = 40, rate: float = 0.3, l1: float = 1e-4, least: int = 4, ratio: float = 3.0, seed: int = 3) -> tuple[dict[bytes, float], float]:
    """Weights by feature, and the offset."""
    found = [[features(t) for t in group] for group in (positive, unlabelled)]
    df, df_u = (Counter(x for f in group for x in f) for group in found)
    # features as common among toxic texts as elsewhere tell nothing: keep those `ratio` times as common
    names = sorted(x for x, n in df.items() if n >= max(least, 0.01 * len(positive)) and n * len(unlabelled) >= ratio * (df_u[x] + 1) * len(positive))
    number = {x: i for i, x in enumerate(names)}
    sets = [[np.array(sorted(number[x] for x in f if x in number), np.int64) for f in group] for group in found]
    w, b, rng = np.zeros(len(names)), float(np.log(prior / (1 - prior))), np.random.default_rng(seed)
    square = np.full(len(names), 1e-4)
    n_batches = max(1, len(unlabelled) // 400)
    loss = lambda z: np.logaddexp(0, -z)
    for _ in range(epochs):
        order = [np.array_split(rng.permutation(len(g)), n_batches) for g in sets]
        for picks in zip(*order, strict=True):
            if not all(map(len, picks)):
                continue
            flat, size, out = [], [], []
            for group, pick in zip(sets, picks, strict=True):
                rows = [group[i] for i in pick]
                flat.append(np.concatenate(rows))
                size.append(np.array([len(x) for x in rows]))
                out.append(np.bincount(np.repeat(np.arange(len(rows)), size[-1]), w[flat[-1]], len(rows)) + b)
            corrected = loss(-out[1]).mean() - prior * loss(-out[0]).mean()
            as_clean = -prior * _sigmoid(out[0]) / len(out[0]), _sigmoid(out[1]) / len(out[1])
            d = (as_clean[0] - prior * _sigmoid(-out[0]) / len(out[0]), as_clean[1]) if corrected >= 0 else (-as_clean[0], -as_clean[1])
            g = sum(np.bincount(f, np.repeat(x, n), len(names)) for f, x, n in zip(flat, d, size, strict=True))
            square += g * g
            step = rate / np.sqrt(square)
            w -= step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1 * prior, 0)
            b -= rate * float(d[0].sum() + d[1].sum())
    # the cut with the largest recall**2 / share of unlabelled texts above it becomes the score CUT
    z = [np.array([w[x].sum() for x in g]) + b for g in sets]
    cuts = np.unique(np.concatenate(z))
    cuts = (cuts[1:] + cuts[:-1]) / 2
    if len(cuts):
        recall, share = (1 - np.searchsorted(np.sort(x), cuts) / max(len(x), 1) for x in z)
        # the share cannot be below that of the toxic texts found; less means that the sample of positives was learnt by heart
        best = int(np.argmax(recall**2 / np.maximum(share, np.maximum(prior * recall, 1e-9))))
        b += float(np.log(CUT / (1 - CUT)) - cuts[best])
    return {x: float(w[i]) for x, i in number.items() if w[i]}, b


def train(docs: DataFrame, labels: DataFrame, fold_ok, label: str = "toxic", positives: int = 1500, unlabelled: int = 4000) -> tuple[dict[bytes, float], float] | None:
    """Weights from the rows where fold_ok (a Column on doc_id) holds; the prior is the toxic share of the labelled ones."""
    known = labels.filter(fold_ok).select("doc_id", label).distinct()
    toxic, rows = known.agg(F.count(F.when(F.col(label) == 1, 1)), F.count(label)).first()
    if not toxic:
        return None
    confirmed = of_class(docs, known, label, 1, positives)
    clean = docs.select("doc_id", "text").filter(fold_ok)
    others = texts(some(clean, clean.count(), unlabelled), unlabelled)
    return fit(confirmed, others, min(0.5, toxic / rows)) if confirmed and others else None


def classify(docs: DataFrame, model: tuple[dict[bytes, float], float] | None, text: str = "text") -> DataFrame:
    """docs with `score`, the probability that a text is toxic."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    at = docs.columns.index(text)
    weights, offset = model or ({}, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(t: str | None) -> float:
            return sum(sorted([weights.get(x, 0.0) for x in features((t or "").encode())]))

        for batch in batches:
            z = np.array([one(t) for t in batch.column(at).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(z + offset) if model else z * 0.0)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], T.StructField("score", T.DoubleType())]))
