"""Packing documents into windows with the help of a sharded BM25 index.

Documents are encoded once and written. Every document's last part (what whole windows leave over) counts towards the document
frequency of its tokens and the mean length, over the whole corpus. Documents are then dealt to shards of about SHARD_DOCS by what
they say: a tree of hyperplanes over signatures (random projections of the distinct tokens, weighted by their IDF) brings
documents of one vocabulary to one leaf, and a leaf that holds more than a shard, be it copies of one text, is cut by
a hash of the row. The tree is fitted on the signatures of a bounded sample (SAMPLE rows); every row goes through it.
A shard holds an inverted index of its parts with the BM25 weight of each token in each part, under the corpus's
statistics. A seed document opens a window; the index returns unused neighbours, best
first, and they fill the window greedily: those that fit, and at last one that is cut, whose rest stays unused.
All windows but a shard's last are full; the last is told apart into lengths that are powers of two. A seed asks with its
`query_terms` tokens of the largest weight, wherever in the text they stand.

Null texts count as empty and still get their end token; each row is a document, repeated ids or not; an empty
table gives no pieces; other columns are not read. Ties in BM25 go to the first document by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches
from .tokens import encoder

SHARD_DOCS = 1024
#: Rows whose signatures the driver takes to fit the tree (64 numbers each), and rows that a leaf of the tree has among them at least.
SAMPLE, LEAF_SAMPLE = 65_536, 16
DIMS = 64
#: Rows that each task's counts by token are cut into, so that they are added up in parallel.
CHUNKS = 64


@dataclass(frozen=True)
class Packer:
    window: int = 2048
    end_id: int = 1
    query_terms: int = 24
    neighbours: int = 16
    #: Share of the best neighbour's score below which another is no alternative to cutting the best.
    near: float = 0.5
    k1: float = 1.2
    b: float = 0.75


@dataclass
class Corpus:
    """Statistics of all documents' last parts: IDF by token id, and the mean length."""

    idf: np.ndarray
    mean: float

    @staticmethod
    def of(n: int, df: np.ndarray, length: int) -> Corpus:
        return Corpus(np.log1p((n - df + 0.5) / (df + 0.5)), length / max(n, 1))


def distinct(ids: np.ndarray) -> np.ndarray:
    """Sorted distinct ids; those of two bytes are sorted by radix."""
    s = np.sort(ids, kind="stable")
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


class Signer:
    """Signatures of documents: the sum of a random vector of signs for each distinct token, weighted by its IDF, scaled to length 1."""

    def __init__(self, corpus: Corpus, seed: int = 29):
        self.idf = corpus.idf.astype(np.float32)
        self.signs = np.random.default_rng(seed).integers(0, 2, (len(self.idf), DIMS), np.int8) * np.int8(2) - np.int8(1)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        known = distinct(ids)
        out = self.idf[known] @ self.signs[known].astype(np.float32)
        return out / max(float(np.linalg.norm(out)), 1e-9)


def tree(sample: np.ndarray, depth: int, seed: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of the 2**depth - 1 inner nodes, in the order of a heap: each halves its part of the sample along the part's main direction."""
    rng = np.random.default_rng(seed)
    directions, cuts = np.zeros((2**depth - 1, DIMS), np.float32), np.zeros(2**depth - 1, np.float32)
    parts = {0: np.arange(len(sample))}
    for node in range(2**depth - 1):
        own = sample[parts[node]]
        v = rng.standard_normal(DIMS).astype(np.float32)
        if len(own) > 1:
            centred = own - own.mean(0)
            for _ in range(4):  # power iteration
                v = centred.T @ (centred @ v)
                v /= max(float(np.linalg.norm(v)), 1e-9)
            cuts[node] = np.median(own @ v)
        directions[node] = v
        right = own @ v > cuts[node]
        parts[2 * node + 1], parts[2 * node + 2] = parts[node][~right], parts[node][right]
    return directions, cuts


def leaves(signatures: np.ndarray, nodes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    directions, cuts = nodes
    at, inner = np.zeros(len(signatures), np.int64), len(cuts)
    while len(at) and at[0] < inner:
        at = 2 * at + 1 + ((signatures * directions[at]).sum(1) > cuts[at])
    return at - inner


class Bm25:
    """Inverted index of one shard: for each token the parts that hold it, with their weights, under the corpus's IDF and mean length or else the shard's own."""

    def __init__(self, parts: list[np.ndarray], p: Packer, corpus: Corpus | None = None):
        counted = [np.unique(x, return_counts=True) for x in parts]
        term = np.concatenate([t for t, _ in counted]) if parts else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in counted]).astype(np.float64) if parts else np.zeros(0)
        sizes = np.array([len(t) for t, _ in counted], np.int64)
        doc = np.repeat(np.arange(len(parts)), sizes)
        length = np.array([len(x) for x in parts], np.float64)
        df = np.bincount(term, minlength=1)
        idf, mean = (np.log1p((len(parts) - df + 0.5) / (df + 0.5)), length.mean() if len(parts) else 0.0) if corpus is None else (corpus.idf, corpus.mean)
        weight = idf[term] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length[doc] / max(mean, 1e-9))) if len(term) else tf
        order = np.argsort(term, kind="stable")
        self.n, self.p = len(parts), p
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(df)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = []
        for i in range(len(parts)):
            t, w = term[ends[i] : ends[i + 1]], weight[ends[i] : ends[i + 1]]
            if len(t) > p.query_terms:
                t = t[np.sort(np.argpartition(-w, p.query_terms - 1)[: p.query_terms])]
            self.terms.append(t)

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every part for the seed's own most telling tokens."""
        at = [slice(self.start[t], self.start[t + 1]) for t in self.terms[seed].tolist()]
        if not at:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[s] for s in at]), np.concatenate([self.weight[s] for s in at]), self.n)


def pack_shard(documents: list[np.ndarray], p: Packer, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, sequences numbered from 0."""
    out, sequence = [], 0
    start, left = [], []
    for i, ids in enumerate(documents):
        whole = len(ids) // p.window
        for k in range(whole):
            out.append((i, k * p.window, p.window, sequence, 0))
            sequence += 1
        start.append(whole * p.window)
        left.append(len(ids) - whole * p.window)
    index = Bm25([ids[a:] for ids, a in zip(documents, start, strict=True)], p, corpus)
    unused = np.array(left) > 0
    room, window = p.window, []

    def place(i: int) -> None:
        nonlocal room
        n = min(left[i], room)
        window.append((i, start[i], n, p.window - room))
        start[i] += n
        left[i] -= n
        room -= n
        if not left[i]:
            unused[i] = False

    for seed in range(len(documents)):
        while left[seed]:
            place(seed)
            while room and unused.any():
                score = np.where(unused, index.scores(seed), -1.0)
                best = np.argsort(-score, kind="stable")[: p.neighbours]
                best = [i for i in best.tolist() if unused[i] and score[i] >= p.near * score[best[0]]]
                for i in best:
                    if left[i] <= room:
                        place(i)
                cut = next((i for i in best if left[i]), None)
                if room and cut is not None:
                    place(cut)
            if room:
                break  # nothing is left to place
            out += [(i, a, n, sequence, at) for i, a, n, at in window]
            sequence, room, window = sequence + 1, p.window, []
    # the last window, if not full: sequences whose lengths are the powers of two of its length
    sizes = [1 << k for k in range(p.window.bit_length(), -1, -1) if (p.window - room) >> k & 1]
    pieces = [(i, a, n) for i, a, n, _ in window]
    for size in sizes:
        at = 0
        while at < size:
            i, a, n = pieces.pop(0)
            take = min(n, size - at)
            out.append((i, a, take, sequence, at))
            at += take
            if take < n:
                pieces.insert(0, (i, a + take, n - take))
        sequence += 1
    return out


def pack(docs: DataFrame, vocabulary: tuple[str, str, str], packer: Packer = Packer()) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids are packed unsigned 32-bit little-endian."""
    spark = docs.sparkSession
    small_batches(spark)
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    names = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    out_schema = T.StructType([id_field, *[T.StructField(k, t) for k, t in names]])
    written = materialize(_encoded(docs, vocabulary, packer), "packing-ids")
    corpus, n = _corpus(written.filter("chunk is not null").select("chunk", "ids"))
    if not n:
        return spark.createDataFrame([], out_schema)
    rows = written.filter("chunk is null").select("doc_id", "row", "ids")
    shared = spark.sparkContext.broadcast(corpus)  # one number for each token of the vocabulary

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(shared.value)
        for batch in batches:
            found = [signer(narrow(x)).tolist() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float32()))], names=["row", "signature"])

    depth = (-(-n // SHARD_DOCS) - 1).bit_length()
    depth = min(depth, (SAMPLE // LEAF_SAMPLE).bit_length() - 1)
    nodes, counts = (np.zeros((0, DIMS), np.float32), np.zeros(0, np.float32)), np.array([n])
    if depth:
        bound = (1 << 40) if n <= SAMPLE else int((1 << 40) * SAMPLE / n)
        some = rows.filter(F.pmod("row", F.lit(1 << 40)) < bound).select("ids", "row").mapInArrow(sign, "row long, signature array<float>").limit(2 * SAMPLE).toArrow().sort_by("row")
        sample = some.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
        nodes = tree(sample, depth)
        # the rows of each leaf, as the sample tells: all rows, if it holds them
        counts = np.bincount(leaves(sample, nodes), minlength=1 << depth) * n // max(len(sample), 1)
    spread = spark.sparkContext.broadcast(nodes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(shared.value) if len(spread.value[1]) else None
        for batch in batches:
            held = batch.column(2).to_pylist()
            leaf = leaves(np.stack([signer(narrow(x)) for x in held]), spread.value) if signer and held else np.zeros(len(held), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["doc_id", "row", "ids", "leaf"])

    routed = rows.mapInArrow(route, T.StructType([id_field, T.StructField("row", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("leaf", T.LongType())]))
    cut = np.maximum(-(-counts // SHARD_DOCS), 1)
    first = F.array(*[F.lit(int(x)) for x in np.cumsum(cut) - cut])
    many = F.array(*[F.lit(int(x)) for x in cut])
    shard_of = F.get(first, F.col("leaf")) + F.pmod(F.xxhash64("row"), F.get(many, F.col("leaf")))

    def shard(rows: pa.Table) -> pa.Table:
        found = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("ids").to_pylist(), rows.column("row").to_pylist(), strict=True), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[2]))
        number, documents = rows.column("shard")[0].as_py(), [unpacked(x) for _, x, _ in found]
        pieces = pack_shard(documents, packer, shared.value)
        long = lambda k: pa.array([x[k] for x in pieces], pa.int64())
        return pa.table(
            {
                "doc_id": pa.array([found[x[0]][0] for x in pieces], rows.schema.field("doc_id").type),
                "start": long(1),
                "length": long(2),
                "ids": pa.array([documents[i][a : a + n].tobytes() for i, a, n, _, _ in pieces], pa.binary()),
                "doc_tokens": pa.array([len(documents[x[0]]) for x in pieces], pa.int64()),
                "sequence_id": pa.array([(number << 32) + x[3] for x in pieces], pa.int64()),
                "offset": long(4),
            }
        )

    dealt = routed.select("doc_id", "row", "ids", shard_of.cast("long").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(shard, out_schema)


def narrow(x: bytes) -> np.ndarray:
    """Ids below 65536 travel in two bytes; an odd length marks four."""
    return np.frombuffer(x, "<u2") if len(x) % 2 == 0 else np.frombuffer(x, "<u4", offset=1)


def unpacked(x: bytes) -> np.ndarray:
    return narrow(x).astype("<u4")


def _encoded(docs: DataFrame, vocabulary: tuple[str, str, str], packer: Packer) -> DataFrame:
    """(doc_id, row, ids) of each row, `row` a hash that tells even equal rows apart; and rows (chunk, ids) with each task's counts by token."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(*vocabulary)
        one, end = known.one, np.array([packer.end_id], "<u4").tobytes()
        size = max(len(known.bytes_of), packer.end_id + 1)
        df, n, length, id_type = np.zeros(-(-size // CHUNKS) * CHUNKS, np.int64), 0, 0, None
        for batch in batches:
            id_type, packed = batch.column(0).type, []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(one(text) + end, "<u4")
                ids = ids.astype("<u2") if ids.max() < 65536 else ids
                left = ids[len(ids) // packer.window * packer.window :]
                df[distinct(left)] += 1
                n, length = n + 1, length + len(left)
                packed.append(ids.tobytes() if ids.itemsize == 2 else b"\0" + ids.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.nulls(len(packed), pa.int32()), pa.array(packed, pa.binary())], names=schema.names)
        if id_type is not None:
            parts = [x.tobytes() for x in (*np.split(df, CHUNKS), np.array([n, length], np.int64))]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), id_type), pa.nulls(len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=schema.names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    row = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())  # written once, so that it is the same for all that read it
    return docs.select("doc_id", "text", row.alias("row")).mapInArrow(encode, schema)


def _corpus(parts: DataFrame) -> tuple[Corpus, int]:
    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in rows.column("ids").to_pylist())
        return pa.table({"chunk": rows.column("chunk")[:1], "ids": pa.array([total.tobytes()], pa.binary())})

    found = {r.chunk: np.frombuffer(r.ids, np.int64) for r in parts.groupBy("chunk").applyInArrow(add, "chunk int, ids binary").collect()}  # CHUNKS + 1 rows
    if not found:
        return Corpus(np.zeros(0), 0.0), 0
    n, length = found.pop(CHUNKS).tolist()
    return Corpus.of(n, np.concatenate([found[k] for k in range(CHUNKS)]), length), n
