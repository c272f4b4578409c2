"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of WIDTH bytes run over the whole text every STRIDE bytes, each filter is max-pooled over
chunks of 1024 bytes that overlap by half, and the chunks' largest and mean responses make one probability.
Scores depend on the text alone, whatever rows share a batch. Training takes a bounded sample of labelled rows (the
parameters `rows` and `epochs` of `train`); scoring takes every row and every byte.

Null and empty texts score as a text of no bytes; repeated rows score alike; an empty table gives no rows; without
labelled rows of both kinds every score is 0.5; other columns pass through and `score` replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches
from .labelled import of_class

WIDTH, STRIDE, HALF, EMBED, FILTERS = 8, 4, 512, 8, 16
#: Bytes that are convolved at once.
PIECE = 1 << 15


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    @staticmethod
    def fresh(seed: int) -> Net:
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(size=s).astype(np.float32)
        return Net(normal(256, EMBED), normal(WIDTH * EMBED, FILTERS) / np.float32(np.sqrt(WIDTH * EMBED)), np.zeros(FILTERS, np.float32), normal(2 * FILTERS) * np.float32(0.1), np.zeros(1, np.float32))


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes, each padded with at least WIDTH zeros to whole half chunks, and the half chunks of each."""
    halves = np.array([-(-(len(t) + WIDTH) // HALF) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves, strict=True)), np.uint8), halves


def _forward(net: Net, texts: list[bytes], learn: bool = False):
    laid, halves = _laid(texts)
    x = np.concatenate([net.embed[laid], np.zeros((WIDTH, EMBED), np.float32)])
    n = len(laid) // STRIDE
    windows = as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
    z = np.maximum(windows @ net.filters + net.bias, 0)
    per_half = HALF // STRIDE
    ends = np.cumsum(halves)
    z[ends * per_half - 1] = 0  # this window would reach into the next text
    cube = z.reshape(-1, per_half, FILTERS)
    peak = cube.max(1)
    last = np.zeros(len(peak), bool)
    last[ends - 1] = True
    chunk = np.where(last[:, None], peak, np.maximum(peak, np.concatenate([peak[1:], peak[:1]])))
    starts = ends - halves
    top, mean = np.maximum.reduceat(chunk, starts), np.add.reduceat(chunk, starts) / halves[:, None]
    features = np.concatenate([top, mean], 1)
    score = 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ net.out + net.offset, -30, 30)))
    return (score, laid, halves, cube, peak, chunk, last, features, windows) if learn else score


def scores(net: Net | None, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 of each text."""
    if net is None:
        return np.full(len(texts), 0.5)
    out, part, size = [], [], 0
    for t in texts:
        part.append(t)
        size += len(t) + HALF
        if size >= PIECE:
            out.append(_forward(net, part))
            part, size = [], 0
    if part:
        out.append(_forward(net, part))
    return np.concatenate(out) if out else np.zeros(0)


def _gradients(net: Net, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    score, laid, halves, cube, peak, chunk, last, features, windows = _forward(net, texts, True)
    error = ((score - labels) / len(texts)).astype(np.float32)
    doc = np.repeat(np.arange(len(texts)), halves)
    d_features = error[:, None] * net.out
    d_top, d_mean = d_features[:, :FILTERS], d_features[:, FILTERS:]
    starts = np.cumsum(halves) - halves
    d_chunk = (d_mean / halves[:, None])[doc]
    is_top = chunk == features[doc, :FILTERS]
    d_chunk = d_chunk + d_top[doc] * is_top / np.maximum(np.add.reduceat(is_top.astype(np.float32), starts), 1)[doc]
    following = np.concatenate([peak[1:], peak[:1]])
    from_next = ~last[:, None] & (following > peak)
    d_peak = np.where(from_next, 0, d_chunk)
    d_peak += np.roll(np.where(from_next, d_chunk, 0), 1, axis=0)
    where = cube.argmax(1)
    half, k = np.nonzero((d_peak != 0) & (peak > 0))
    g = d_peak[half, k]
    at = half * (HALF // STRIDE) + where[half, k]
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    rows = windows[at]
    for f in range(FILTERS):
        m = k == f
        d_filters[:, f] = g[m] @ rows[m]
    near = laid[np.minimum(at[:, None] * STRIDE + np.arange(WIDTH), len(laid) - 1)]
    np.add.at(d_embed, near, (g[:, None] * net.filters[:, k].T).reshape(-1, WIDTH, EMBED))
    return [d_embed, d_filters, np.bincount(k, g, FILTERS).astype(np.float32), features.T @ error, np.array([error.sum()], np.float32)]


def train(docs: DataFrame, labels: DataFrame, fold_ok, label: str = "quality", rows: int = 1500, epochs: int = 16, seed: int = 5) -> Net | None:
    """A net from about `rows` texts of either label among the rows where fold_ok (a Column on doc_id) holds."""
    known = labels.filter(fold_ok)
    one, zero = (of_class(docs, known, label, k, rows) for k in (1, 0))
    if not one or not zero:
        return None
    rng = np.random.default_rng(seed)
    texts, y = one + zero, np.array([1.0] * len(one) + [0.0] * len(zero))
    net = Net.fresh(seed)
    params = [net.embed, net.filters, net.bias, net.out, net.offset]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.012 * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            step += 1
            for i, g in enumerate(_gradients(net, [texts[j] for j in pick], y[pick])):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    # the sample holds both labels alike; the labelled rows do not
    shares = dict(known.groupBy(label).count().collect())
    net.offset += np.float32(np.log(shares[1] / shares[0] * len(zero) / len(one)))
    return net


def classify(docs: DataFrame, net: Net | None, text: str = "text") -> DataFrame:
    """docs with `score`, the probability of label 1."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = scores(net, [(t or "").encode() for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], T.StructField("score", T.DoubleType())]))
