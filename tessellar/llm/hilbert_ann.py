"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one entry with its smallest ids. Each of several curves projects the vectors to a few random orthonormal
directions, shifts the grid by a random offset and orders the cells by Hilbert's curve; equal cells are ordered by a hash.
A curve's order is cut into ranges of about BLOCK_ROWS entries at quantiles of the key. A query meets the entries of its own range and of
those within `reach` of all entries on either side, range by range, in double precision; the best of each meeting are
merged over all ranges and curves.

With data of no structure (as good as isotropic in many dimensions) no curve keeps neighbours together, and recall is the share of
the order that the windows cover: reach is the least fraction of all entries on either side, rounded up to whole ranges, so that few
ranges cover more. Recall is measured in the README.

Vectors that are null, zero, hold null or non-finite components, or differ in length from the most frequent length (the
smaller of equals) take no part. Repeated ids are entries of their own. Fewer than k candidates: all of them. Ties go to
the smaller id. An empty table gives no rows. Other columns are not read.
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

BLOCK_ROWS = 4096
LEAST_BLOCKS = 24


@dataclass(frozen=True)
class Curves:
    curves: int = 12
    dims: int = 4
    bits: int = 6
    reach: float = 0.042
    k: int = 20
    seed: int = 23


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along Hilbert's curve of integer cells (rows of coordinates below 2**bits), by the transposed-axes transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for k in range(bits - 1, 0, -1):
        bit, low = 1 << k, (1 << k) - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        turn = np.where(x[n - 1] & (1 << k), turn ^ ((1 << k) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> k) & 1)
    return key


def projections(dims: int, p: Curves) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and shift (in cells) of each curve."""
    rng = np.random.default_rng(p.seed)
    return [(np.linalg.qr(rng.normal(size=(dims, min(p.dims, dims))))[0], rng.random(min(p.dims, dims))) for _ in range(p.curves)]


def reach_of(blocks: int, p: Curves) -> int:
    """Blocks on either side that a query meets: never less than the fraction `reach` of all."""
    return max(1, math.ceil(p.reach * blocks))


def _usable(vectors: DataFrame, vector: str, id_: str) -> DataFrame:
    """(id, v): double vectors that take part."""
    v = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.filter(sound & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def search(vectors: DataFrame, queries: Column, vector: str = "embedding", id_: str = "vec_id", p: Curves = Curves()) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where queries (a Column on `id`) holds, the k nearest found by inner product."""
    spark = vectors.sparkSession
    usable = _usable(vectors, vector, id_)
    lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0].d
    usable = materialize(usable.filter(F.size("v") == dims), "ann-rows")
    # one entry for each distinct vector: its smallest k + 1 ids (a query may be one of them)
    order = Window.partitionBy("v").orderBy("id")
    first = usable.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= p.k + 1)
    entries = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("entry", F.col("ids")[0])
    asked = usable.filter(queries).select(F.col("id").alias("query_id"), "v")
    entries = materialize(entries.join(asked.select("v").distinct().withColumn("asked", F.lit(True)), "v", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "ann-entries")
    n, square = entries.agg(F.count("*"), F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    sigma = float(np.sqrt(square / dims))
    maps = projections(dims, p)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(-1, dims)
            out = []
            for directions, shift in maps:
                cell = (x @ directions / sigma + 3) / 6 * ((1 << p.bits) - 1) + shift
                out.append(hilbert(np.clip(np.floor(cell), 0, (1 << p.bits) - 1), p.bits))
            flat = pa.array(np.stack(out, 1).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(maps)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=[*batch.schema.names, "keys"])

    keyed = entries.select("v", "entry", "asked").mapInArrow(keys, "v array<double>, entry long, asked boolean, keys array<long>")
    # equal cells are dealt by a hash, so that quantiles cut them as well
    spread = F.pmod(F.xxhash64("entry"), F.lit(1 << 30))
    keyed = materialize(keyed.withColumn("keys", F.transform("keys", lambda k: k * F.lit(1 << 30) + spread)), "ann-keys")
    blocks = max(1, min(n, max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))))
    reach = reach_of(blocks, p)
    shares = [i / blocks for i in range(1, blocks)]
    cuts = [[int(x) for x in c] for c in keyed.agg(*[F.percentile_approx(F.col("keys")[i], shares, 100_000).alias(f"c{i}") for i in range(p.curves)]).first()] if shares else [[] for _ in range(p.curves)]
    limits = spark.sparkContext.broadcast([np.unique(np.array(c, np.int64)) for c in cuts])  # one number per block and curve

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(2).flatten().to_numpy().reshape(-1, p.curves)
            at = np.stack([np.searchsorted(limits.value[i], k[:, i], "left") for i in range(p.curves)], 1).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, p.curves).astype(np.int32)), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), listed], names=["v", "entry", "asked", "at"])

    placed = keyed.select("v", "entry", "keys", "asked").mapInArrow(place, "v array<double>, entry long, asked boolean, at array<int>")
    near = placed.select("v", "entry", F.posexplode("at").alias("curve", "block"))
    ask = placed.filter("asked").select("v", "entry", F.posexplode("at").alias("curve", "own"))
    ask = ask.withColumn("block", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach))).filter(F.col("block").between(0, blocks - 1)).drop("own")

    def meet(queries: pa.Table, found: pa.Table) -> pa.Table:
        none = pa.table({"asked": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not found.num_rows:
            return none
        matrix = lambda t: np.concatenate([c.flatten().to_numpy() for c in t.column("v").chunks]).reshape(-1, dims)
        candidates, names = matrix(found), found.column("entry").to_numpy()
        order = np.argsort(names)
        candidates, names, asked, wanted = candidates[order], names[order], queries.column("entry").to_numpy(), matrix(queries)
        out = []
        for lo in range(0, len(asked), 512):
            score = wanted[lo : lo + 512] @ candidates.T
            top = np.argsort(-score, axis=1, kind="stable")[:, : p.k + 1]
            out.append((np.repeat(asked[lo : lo + 512], top.shape[1]), names[top].ravel(), np.take_along_axis(score, top, 1).ravel()))
        return pa.table({k: pa.array(np.concatenate([o[i] for o in out])) for i, k in enumerate(("asked", "entry", "score"))})

    met = ask.groupBy("curve", "block").cogroup(near.groupBy("curve", "block")).applyInArrow(meet, "asked long, entry long, score double")
    best = met.groupBy("asked", "entry").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("asked").orderBy(F.desc("score"), "entry")
    best = best.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= p.k + 1).drop("r")
    # back to ids: every query row of an entry, against the ids of the entries found
    ids = best.join(entries.select("entry", "ids"), "entry").select("asked", "score", F.explode("ids").alias("vec_id"))
    cut = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(cut)).filter(F.col("r") <= p.k + 1).groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    mine = asked.join(entries.select("v", F.col("entry").alias("asked")), "v").drop("v").join(ids, "asked")
    own = F.slice(F.filter("hits", lambda h: h.vec_id != F.col("query_id")), 1, p.k)
    return mine.select("query_id", F.posexplode(own).alias("i", "h")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))
