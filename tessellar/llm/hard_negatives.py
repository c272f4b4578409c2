"""Hard negatives by blocked dense products.

Vectors become integers, floor(scale * x), and every score is an exact integer inner product: a matrix product in float64 where no
sum can reach 2**53, else one over Python's integers (cut off at the ends of a long). Anchors are cut into blocks of about
`block` rows, and one block at a time is broadcast to all rows: a first pass keeps each anchor's best rows of its own label (its
positives) in every task, and the tasks' lists are merged; a second pass does the same for each positive over the rows of other
labels whose score lies in the positive's window. A task holds `block` times TILE scores at once and its own lists; the driver holds
one block and its positives.

Rows whose id, label or vector is null, or whose vector has a null or non-finite component, take no part. Vectors of other
lengths are filled up with zeros (an empty one scores 0 with all). Rows that repeat an id are rows of their own, except that an anchor has none of its
own id beside it and that of several anchors with one id the least label, then the least vector, is the anchor. Ties go to
the smaller id. No anchors, no positives or no negatives: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TILE = 4096
MOST = 2**63 - 1
#: Below every score.
NONE = -MOST


@dataclass(frozen=True)
class Mining:
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    #: A negative's score is at least this percentage of its positive's, and at most the positive's.
    percent: int = 80
    #: Anchors that are broadcast at once.
    block: int = 4096


def integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat integer components (as doubles), the offsets of the rows, and which rows take part."""
    parts = vectors.flatten()
    flat = np.floor(parts.fill_null(math.nan).to_numpy(zero_copy_only=False) * float(scale))
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    return flat, ends - lengths, vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])


def matrix(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, dims: int) -> np.ndarray:
    """Rows of `dims` components: cut off, or filled up with zeros."""
    out = np.zeros((len(starts), dims))
    lengths = np.minimum(ends - starts, dims)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out[rows, :n] = flat[starts[rows, None] + np.arange(n)]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all of b."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -MOST + 1, MOST).astype(np.int64)


def merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray) -> None:
    """Put the largest of scores (a row for each list, a column for each of ids, which ascend) into the lists of (score, id), best first."""
    k = best[0].shape[1]
    rows = np.flatnonzero((scores.max(axis=1) >= best[0][:, -1]) & (scores.max(axis=1) > NONE))
    if not len(rows):
        return
    left = scores[rows]
    found_s, found_i = np.full((len(rows), k), NONE), np.zeros((len(rows), k), dtype=np.int64)
    at = np.arange(len(rows))
    for j in range(min(k, left.shape[1])):
        top = left.argmax(axis=1)  # the first of equals has the smallest id
        found_s[:, j], found_i[:, j] = left[at, top], ids[top]
        left[at, top] = NONE
    s, i = np.concatenate((best[0][rows], found_s), axis=1), np.concatenate((best[1][rows], found_i), axis=1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    best[0][rows], best[1][rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _tiles(batches: Iterator[pa.RecordBatch], scale: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of rows that take part, ascending ids."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TILE):
            part = batch.slice(lo, TILE)
            flat, starts, sound = integers(part.column(2), scale)
            ends = np.append(starts[1:], len(flat))
            sound &= part.column(0).is_valid().to_numpy(zero_copy_only=False) & part.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids, labels = (part.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in (0, 1))
            rows = np.flatnonzero(sound)
            rows = rows[np.argsort(ids[rows], kind="stable")]
            if len(rows):
                yield ids[rows], labels[rows], matrix(flat, starts[rows], ends[rows], dims)


def mine(vectors: DataFrame, anchors: Column, id_: str = "vec_id", vector: str = "embedding", label: Column | str = "label", p: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors: a Column on `id`, label: one on the columns of vectors."""
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    asked = rows.filter(anchors & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(sound).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a"))
    asked = materialize(asked.select("id", "a.label", "a.v"), "anchors")
    blocks = math.ceil(asked.count() / p.block)
    results = []
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if block.num_rows:
            results.append(materialize(_mine_block(rows, block, p), "negatives"))
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def _mine_block(rows: DataFrame, block: pa.Table, p: Mining) -> DataFrame:
    """The rows of one block of anchors: two passes over all rows."""
    ids, labels = (block.column(c).to_numpy() for c in ("id", "label"))
    chunks = block.column("v").chunks
    flat, starts, _ = integers(chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks), p.scale)
    ends = np.append(starts[1:], len(flat))
    dims = int((ends - starts).max())
    a = matrix(flat, starts, ends, dims)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), p.positives), NONE), np.zeros((len(ids), p.positives), dtype=np.int64)
        for c_ids, c_labels, c in _tiles(batches, p.scale, dims):
            scores = products(a, c)
            scores[(labels[:, None] != c_labels) | (ids[:, None] == c_ids)] = NONE
            merged(best, scores, c_ids)
        at, slot = np.nonzero(best[0] > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[1][at, slot]), pa.array(best[0][at, slot])], ["at", "id", "score"])

    best_first = [F.desc("score"), F.col("id")]
    order = Window.partitionBy("at").orderBy(*best_first)
    first = rows.mapInArrow(positives, "at long, id long, score long").withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < p.positives).collect()
    found = sorted((r["slot"], r["at"], r["id"], r["score"]) for r in first)
    by_slot = [[np.array(x, dtype=np.int64) for x in zip(*[r[1:] for r in found if r[0] == s])] for s in range(p.positives)]
    by_slot = [x for x in by_slot if x]

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.full((len(at), p.negatives), NONE), np.zeros((len(at), p.negatives), dtype=np.int64)) for at, _, _ in by_slot]
        least = [np.array([-((-p.percent * int(s)) // 100) for s in score], dtype=np.int64) for _, _, score in by_slot]
        for c_ids, c_labels, c in _tiles(batches, p.scale, dims):
            scores = products(a, c)
            scores[(labels[:, None] == c_labels) | (ids[:, None] == c_ids)] = NONE
            for (at, _, score), low, lists in zip(by_slot, least, best):
                own = scores[at]
                own[(own > score[:, None]) | (own < low[:, None])] = NONE
                merged(lists, own, c_ids)
        for slot, ((at, pos, score), (s, i)) in enumerate(zip(by_slot, best)):
            r, j = np.nonzero(s > NONE)
            columns = [ids[at[r]], pos[r], score[r], np.full(len(r), slot), i[r, j], s[r, j]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["anchor_id", "positive_id", "positive_score", "slot", "id", "score"])

    order = Window.partitionBy("anchor_id", "slot").orderBy(*best_first)
    ranked = rows.mapInArrow(negatives, "anchor_id long, positive_id long, positive_score long, slot long, id long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
