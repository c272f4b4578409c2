"""Cosine search over vectors: exact in blocks, and through cells that are the partitions of a stored table.

Queries are taken in blocks of BLOCK, whose vectors are broadcast; every task multiplies its rows with the block (one matrix product for
each batch) and keeps the k best of each query; the tasks' lists are merged. Any number of queries is a number of blocks. Scores are rounded to
nine places, ties go to the smaller key. Vectors that are null, of another length than the queries', zero, or with null or non-finite
components take no part, on either side. Rows that repeat a key are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Queries that are broadcast at once, and rows that meet them at once.
BLOCK, TILE = 1024, 4096
#: Rows that cells are fitted on, at most, and cells at most.
SAMPLE, MOST_CELLS = 65_536, 4096
#: Rows in a cell's file.
FILE_ROWS = 100_000


def unit_rows(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the rows that take part, their vectors of length 1)."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if dims is None:
        dims = int(lengths.max(initial=0))
    if dims <= 0:
        return np.empty(0, np.int64), np.empty((0, 0))
    at = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(at)).flatten().fill_null(math.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
    sizes = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    sound = np.isfinite(sizes) & (sizes > 0)
    return at[sound], flat[sound] / sizes[sound, None]


@dataclass
class _Best:
    """The k best (score, key) of each query so far."""

    k: int
    scores: list[np.ndarray]
    keys: list[list]

    @staticmethod
    def of(n: int, k: int) -> _Best:
        return _Best(k, [np.empty(0)] * n, [[] for _ in range(n)])

    def add(self, queries: np.ndarray, keys: list, scores: np.ndarray) -> None:
        """scores: a row for each of queries, a column for each of keys."""
        n = scores.shape[1]
        floor = np.array([self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf for q in queries.tolist()])
        if n > self.k:
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        r, c = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r)) + 1):
            if len(part):
                q = int(queries[r[part[0]]])
                pool = [(-s, key) for s, key in zip(self.scores[q], self.keys[q])] + [(-scores[r[i], c[i]], keys[c[i]]) for i in part]
                pool = sorted(pool)[: self.k]
                self.scores[q], self.keys[q] = -np.array([s for s, _ in pool]), [key for _, key in pool]


def _scan(rows: DataFrame, ids: list, unit: np.ndarray, k: int, meets: dict | None, scopes: list | None, schema: str) -> DataFrame:
    """rows: (key, vector, group[, scope]); the k best keys of each query among the rows of the groups it meets (all without `meets`) and of its scope.

    The rank is taken over all tasks' lists.
    """
    queries = {g: np.array(q) for g, q in meets.items()} if meets is not None else None
    everyone = np.arange(len(ids))
    own = {s: np.array([i for i, x in enumerate(scopes) if x == s]) for s in set(scopes) if s is not None} if scopes is not None else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best.of(len(ids), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                part = batch.slice(lo, TILE)
                at, x = unit_rows(part.column(1), unit.shape[1])
                keys, groups = part.column(0), part.column(2).to_numpy(zero_copy_only=False)[at]
                known = keys.is_valid().to_numpy(zero_copy_only=False)[at]
                for g in np.unique(groups) if queries is not None else [None]:
                    asked = everyone if queries is None else queries.get(int(g))
                    here = np.flatnonzero(known if g is None else known & (groups == g))
                    if asked is None or not len(here):
                        continue
                    names = keys.take(pa.array(at[here])).to_pylist()
                    if own is None:
                        best.add(asked, names, np.round(unit[asked] @ x[here].T, 9))
                        continue
                    scope = part.column(3).take(pa.array(at[here])).to_pylist()
                    for s in {v for v in scope if v in own}:
                        mine = np.array([i for i, v in enumerate(scope) if v == s])
                        both = np.intersect1d(asked, own[s])
                        if len(both):
                            best.add(both, [names[i] for i in mine], np.round(unit[both] @ x[here[mine]].T, 9))
        found = [(ids[q], key, s) for q in range(len(ids)) for key, s in zip(best.keys[q], best.scores[q].tolist())]
        target = pa.schema([("query_id", pa.array(ids).type), ("key", rows_key), ("score", pa.float64())])
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], target.field(i).type) for i in range(3)], schema=target)

    rows_key = pa.string() if dict(rows.dtypes)[rows.columns[0]] == "string" else pa.int64()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return rows.mapInArrow(task, schema).withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, scope: str | None) -> Iterator[tuple[list, np.ndarray, list | None]]:
    """(ids, vectors of length 1, scopes) of about BLOCK queries at a time; only those are on the driver."""
    named = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), *([F.col(scope).cast("string").alias("scope")] if scope else []))
    n = named.count()
    blocks = math.ceil(n / BLOCK)
    if blocks > 1:
        named = materialize(named, "queries")
    for i in range(blocks):
        part = (named if blocks == 1 else named.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow().combine_chunks()
        lengths = [v for v in part.column("q").combine_chunks().value_lengths().to_pylist() if v]
        for dims in sorted(set(lengths)):
            at, unit = unit_rows(part.column("q").combine_chunks(), dims)
            if len(at):
                take = lambda c: part.column(c).take(pa.array(at)).to_pylist()  # noqa: E731, B023
                yield take("query_id"), unit, take("scope") if scope else None


def _together(found: list[DataFrame], empty: DataFrame) -> DataFrame:
    """The blocks' results: one stays lazy, more are written as they come."""
    out = None
    for one in found:
        one = materialize(one, "nearest") if len(found) > 1 else one
        out = one if out is None else out.union(one)
    return empty if out is None else out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scope: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the exact k best by cosine for queries (query_id, q). scope: a column of both sides that must be equal; null meets nothing."""
    spark = vectors.sparkSession
    kind, asked = dict(vectors.dtypes)[key], dict(queries.dtypes)["query_id"]
    schema = f"query_id {asked}, key {'string' if kind == 'string' else 'bigint'}, score double"
    rows = vectors.select(F.col(key).cast("string" if kind == "string" else "bigint").alias("key"), F.col(vector).alias("v"), F.lit(0).alias("g"), *([F.col(scope).cast("string").alias("s")] if scope else []))
    found = [_scan(rows, ids, unit, k, None, scopes, schema) for ids, unit, scopes in _blocks(queries, scope)]
    out = _together(found, spark.createDataFrame([], f"{schema}, rank int"))
    return out.select("query_id", F.col("key").cast(kind).alias(key), "score", "rank")


@dataclass(frozen=True)
class Cells:
    """A stored table of vectors in cells: each row lies in the cell whose centre is nearest, cells are the partitions of the files.

    A query meets the rows of the nearest cells that hold a share of all rows, and no other partition is read. What it meets is compared exactly, so what is found is
    right and only what lies in other cells can be missed.
    """

    spark: SparkSession
    path: str
    key: str
    scoped: bool
    kind: str
    centres: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def build(rows: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", scope: str | None = None, cells: int | None = None, seed: int = 7) -> Cells:
        """Fit the centres on SAMPLE rows at most (by a hash of the key), deal every row, and write all once. Without a number there are as many cells as the root of the rows."""
        spark, kind = rows.sparkSession, dict(rows.dtypes)[key]
        named = rows.select(F.col(key).cast("string" if kind == "string" else "bigint").alias("key"), F.col(vector).cast("array<float>").alias("v"), (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("s"))
        n = named.count()
        share = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / max(n, 1)))
        sample = named.filter(share & F.col("v").isNotNull()).select("v").limit(SAMPLE).toArrow().column("v").combine_chunks()
        lengths = sample.value_lengths().to_numpy(zero_copy_only=False)
        dims = int(np.bincount(lengths).argmax()) if len(lengths) else 0
        unit = unit_rows(sample, dims)[1] if dims else np.zeros((1, 1))
        centres = fitted(unit if len(unit) else np.zeros((1, max(dims, 1))), min(MOST_CELLS, cells or max(1, round(math.sqrt(n)))), seed)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = unit_rows(batch.column(1), centres.shape[1])
                keep = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in range(3)), pa.array((x @ centres.T).argmax(axis=1).astype(np.int32) if len(at) else [], pa.int32())], ["key", "v", "s", "cell"])

        dealt = named.mapInArrow(deal, f"key {dict(named.dtypes)['key']}, v array<float>, s string, cell int")
        # one file a cell, and more for a cell that holds many of the sample's rows
        near = np.bincount((unit @ centres.T).argmax(axis=1), minlength=len(centres)) if len(unit) else np.zeros(len(centres))
        files = F.array(*[F.lit(int(x)) for x in np.maximum(1, np.ceil(near / max(near.sum(), 1) * n / FILE_ROWS))])
        dealt.repartition("cell", F.pmod(F.xxhash64("key"), F.get(files, F.col("cell")))).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
        held = spark.read.schema(f"{dealt.schema.fields[0].simpleString().replace(':', ' ')}, v array<float>, s string, cell int").parquet(f"{path}/rows") if n else None
        sizes = dict(held.groupBy("cell").count().collect()) if held is not None else {}
        told = [(i, [float(x) for x in c], int(sizes.get(i, 0)), key, kind, scope is not None) for i, c in enumerate(centres)]
        spark.createDataFrame(told, "cell int, centre array<double>, n bigint, key string, kind string, scoped boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return Cells.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Cells:
        told = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        return Cells(spark, path, told[0].key, told[0].scoped, told[0].kind, np.array([r.centre for r in told]), np.array([r.n for r in told]))

    def probes(self, unit: np.ndarray, share: float) -> np.ndarray:
        """Which cells each query meets: the nearest ones until they hold `share` of all rows, and one at least."""
        order = np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        met = np.zeros(order.shape, bool)
        np.put_along_axis(met, order, before < share * self.sizes.sum(), axis=1)
        return met

    def rows(self) -> DataFrame:
        kind = "string" if self.kind == "string" else "bigint"
        return self.spark.read.schema(f"key {kind}, v array<float>, s string, cell int").parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, share: float = 0.15, scope: str | None = None, without: DataFrame | None = None) -> DataFrame:
        """(query_id, key, score, rank) for queries (query_id, q). share: of all rows that a query meets; 1.0 is exact. without: keys that are passed over."""
        kind, asked = self.kind, dict(queries.dtypes)["query_id"]
        schema = f"query_id {asked}, key {'string' if kind == 'string' else 'bigint'}, score double"
        if scope and not self.scoped:
            raise ValueError("the cells were built without a scope")
        found = []
        for ids, unit, scopes in _blocks(queries, scope):
            if unit.shape[1] != self.centres.shape[1] or not self.sizes.sum():
                continue
            met = self.probes(unit, share)
            meets = {int(c): np.flatnonzero(met[:, c]).tolist() for c in np.flatnonzero(met.any(axis=0))}
            rows = self.rows().select("key", "v", F.col("cell").alias("g"), *(["s"] if scope else []))
            if len(meets) < len(self.sizes):
                rows = rows.filter(F.col("g").isin(sorted(meets)))
            if without is not None:
                rows = rows.join(without.select(F.col(without.columns[0]).alias("key")), "key", "left_anti").select(*rows.columns)
            found.append(_scan(rows, ids, unit, k, meets, scopes, schema))
        out = _together(found, self.spark.createDataFrame([], f"{schema}, rank int"))
        return out.select("query_id", F.col("key").cast(kind).alias(self.key), "score", "rank")

    def met(self, queries: DataFrame, share: float = 0.15) -> float:
        """The share of all rows that a query meets, on average."""
        parts = [(self.probes(unit, share) @ self.sizes / self.sizes.sum()) for _, unit, _ in _blocks(queries, None)]
        return float(np.concatenate(parts).mean()) if parts else 0.0


def fitted(unit: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of length 1 by k-means on directions; a centre that loses all its rows moves to the row that is worst off."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(unit, axis=0)
    centres = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        near, best = np.empty(len(unit), np.int64), np.empty(len(unit))
        for lo in range(0, len(unit), TILE):
            scores = unit[lo : lo + TILE] @ centres.T
            near[lo : lo + TILE], best[lo : lo + TILE] = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        size = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(size == 0)
        centres = sums / np.where(size > 0, size, 1.0)[:, None]
        centres[lost] = unit[np.argsort(best)[: len(lost)]]
    return centres
