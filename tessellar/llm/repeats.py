"""Passages that repeat across documents, counted exactly by super-k-mer partitioning.

A window is `window` consecutive words of one text; a window whose words also start earlier (in a document with a smaller id, or earlier
in the same document) is a repeat, and every word that a repeat covers goes. A window's minimiser is the least hash among its runs of
`gram` words, and consecutive windows with one minimiser are a super-k-mer: it travels once, as one packed string of
all its words, to the bucket of its minimiser, where all equal windows meet. There the windows are sorted by a 64-bit hash; those that share
a hash are compared word by word, so the counts are exact.

Equal super-k-mers of a chunk of texts (CHUNK bytes) travel once, as the earliest of them: the others are repeats
throughout. A first pass counts the super-k-mers of every minimiser over all texts; where one has more than a quarter of a partition's share (a
line that a third of all texts hold, in ever other surroundings), its windows travel alone, to buckets of their own hash. That list
is broadcast: it has at most 120 numbers for each shuffle partition, and never more than 2**25. Buckets hold about BUCKET bytes and are read one at a time.

Null texts have no words. A null doc_id is larger than any other. Rows with one id and different texts are documents of their own, in the
order of a hash of their texts; rows equal in id and text are one document, given several times, and none repeats another. Texts of
any length are cut into segments for the windows, never dropped. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

CHUNK, BUCKET = 4 << 20, 4 << 20
#: Words in a segment of a long text, and windows in a super-k-mer at most.
SEGMENT, LONGEST = 1 << 18, 256
#: Minimisers with fewer super-k-mers always stay together.
LEAST_HOT = 256
#: A super-k-mer of 20-word windows and 5-word minimisers has 8.5 windows on average; packed strings are about 3.2 times the texts.
PER_STRING, SPREAD = 60, 3.2
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Repeats:
    window: int = 20
    gram: int = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Text:
    """Words of a buffer, each ended by one of two bytes, and hashes of any run of words."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, raw: bytes, last: int = 10):
        self.raw, data = raw, np.frombuffer(raw, np.uint8)
        stop = data == 32
        stop |= data == last
        self.ends = np.flatnonzero(stop)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends
        #: Which string of the buffer a word belongs to: strings end with `last`.
        closed = np.cumsum(data[self.ends] == last)
        self.string = closed - (data[self.ends] == last)
        if len(Text._powers[0]) < len(raw):
            n = (len(raw) >> 20) + 1 << 20
            Text._powers = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64)))) for b in (BASE, INVERSE))
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Text._powers[0][: len(raw)], out=self._sums[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words first to last (both included): equal for equal words, in every buffer."""
        at = self.starts[first]
        return mixed((self._sums[self.ends[last]] - self._sums[at]) * Text._powers[1][at])

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows within a string."""
        if len(self.ends) < size:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.string[: len(self.ends) - size + 1] == self.string[size - 1 :])


def minimisers(text: Text, p: Repeats) -> np.ndarray:
    """The least hash among the grams of the window at each word."""
    n = len(text.ends) - p.gram + 1
    least = text.hashes(np.arange(n), np.arange(n) + p.gram - 1)
    have, want = 1, p.window - p.gram + 1
    while have < want:
        step = min(have, want - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return least


def super_kmers(text: Text, hot: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, key) of the super-k-mers of a buffer: runs of windows with one minimiser; a window whose minimiser is hot is alone."""
    at = text.windows(p.window)
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    key = minimisers(text, p)[at]
    alone = np.isin(key, hot)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | alone[1:] | alone[:-1]
    begins = np.flatnonzero(new)
    new[(np.arange(len(at)) - begins[np.cumsum(new) - 1]) % LONGEST == 0] = True
    begins = np.flatnonzero(new)
    first, count, key = at[begins], np.diff(np.append(begins, len(at))), key[begins]
    own = alone[begins]
    key[own] = text.hashes(first[own], first[own] + p.window - 1)
    return first, count, key


@dataclass
class Chunk:
    """Segments of texts in the order of their documents."""

    null: np.ndarray
    doc: np.ndarray
    mark: np.ndarray
    first: np.ndarray
    text: Text


def chunks(batches: Iterator[pa.RecordBatch], p: Repeats) -> Iterator[Chunk]:
    """Texts with a window at least, about CHUNK bytes at a time; of rows equal in id and text one."""
    held: dict[tuple[bool, int, int, int], bytes] = {}
    size = 0

    def chunk() -> Chunk:
        keys = sorted(held)
        null, doc, mark, first = (np.array(x) for x in zip(*keys))
        return Chunk(null, doc, mark, first, Text(b"\n".join([held[k] for k in keys]) + b"\n"))

    for batch in batches:
        for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode().split()
            for lo in range(0, max(1, len(words) - p.window + 1), SEGMENT):
                if len(words) - lo >= p.window:
                    packed = b" ".join(words[lo : lo + SEGMENT + p.window - 1])
                    held[(doc is None, doc or 0, mark, lo)] = packed
                    size += len(packed)
                if size >= CHUNK:
                    yield chunk()
                    held, size = {}, 0
    if held:
        yield chunk()


FIELDS = (("null", np.bool_), ("doc", np.int64), ("mark", np.int64), ("first", np.int64))


def packed(rows: list[np.ndarray], strings: bytes) -> bytes:
    """Columns of one length and the strings (or nothing), compressed together."""
    head = len(rows[0]).to_bytes(8, "little") + len(rows).to_bytes(8, "little")
    return zstandard.compress(head + b"".join(np.asarray(x, np.int64).tobytes() for x in rows) + strings, 3)


def unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(blob)
    n, k = (int.from_bytes(raw[i : i + 8], "little") for i in (0, 8))
    return np.frombuffer(raw, np.int64, n * k, 16).reshape(k, n), raw[16 + 8 * n * k :]


def earliest(text: Text, order: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Of the windows at the words `at`, those whose words stand at a place with a smaller `order` too."""
    found = text.hashes(at, at + size - 1)
    by = np.argsort(found)
    ranked = found[by]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(at), bool)
    shared[1:] |= same
    shared[:-1] |= same
    by = by[shared]
    by = by[np.lexsort((order[by], found[by]))]
    repeat = np.zeros(len(at), bool)
    raw, lows, highs = text.raw, text.starts[at[by]].tolist(), text.ends[at[by] + size - 1].tolist()
    hashes, orders, where = found[by].tolist(), order[by].tolist(), by.tolist()
    run = None
    for i, h in enumerate(hashes):
        own = raw[lows[i] : highs[i]]
        if h != run:  # the first places of different windows with one hash, nearly always one
            run, firsts = h, {own: orders[i]}
        elif firsts.setdefault(own, orders[i]) != orders[i]:
            repeat[where[i]] = True
    return repeat


def spans(string: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of a string joined: the places in `at` of each run's first and last window."""
    breaks = np.flatnonzero((at[1:] != at[:-1] + 1) | (string[1:] != string[:-1]))
    return np.concatenate(([0], breaks + 1)), np.append(breaks, len(at) - 1)


def repeated(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(doc_id, mark, spans): for each document with repeats, the spans [lo, hi) of words that go; mark is the hash of its text. docs: doc_id, text, mark."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "mark", F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = math.ceil(size * SPREAD / parts / BUCKET) or 1
    limit = max(LEAST_HOT, size // PER_STRING // min(4 * parts, 1 << 20))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for c in chunks(batches, p):
            first, count, key = super_kmers(c.text, none, p)
            whole = c.text.hashes(first, first + count + p.window - 2)
            found, n = np.unique(key[np.unique(whole, return_index=True)[1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])

    hot = texts.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).select("key").toArrow()
    hot = hot.column("key").to_numpy().view(np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, p):
            first, count, key = super_kmers(c.text, hot, p)
            if not len(first):
                continue
            raw, string = c.text.raw, c.text.string[first]
            opens = np.searchsorted(c.text.string, np.arange(len(c.doc)))  # first word of each segment
            place = c.first[string] + first - opens[string]
            seen: dict[bytes, int] = {}
            strings = [raw[a:b] for a, b in zip(c.text.starts[first].tolist(), c.text.ends[first + count + p.window - 2].tolist())]
            one = np.fromiter((seen.setdefault(s, i) == i for i, s in enumerate(strings)), bool, len(strings))
            goes = np.flatnonzero(~one)
            rows = [c.null[string], c.doc[string], c.mark[string], place]
            stays = np.flatnonzero(one)
            spread = mixed(key[stays])
            part = (spread % np.uint64(parts)).astype(np.int64)
            group = part * buckets + (spread // np.uint64(parts) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[by])) + 1
            out: list[tuple[int, int, bytes]] = []
            for of in np.split(by, edges):
                own = stays[of]
                out.append((int(part[of[0]]), int(group[of[0]] % buckets), packed([x[own] for x in rows], b"\n".join([strings[i] for i in own.tolist()]) + b"\n")))
            if len(goes):
                out.append((int(mixed(key[goes[:1]])[0] % np.uint64(parts)), -1, packed([*[x[goes] for x in rows], place[goes] + count[goes] + p.window - 1], b"")))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["part", "bucket", "blob"])

    def told(null: np.ndarray, doc: np.ndarray, mark: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(mark, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["doc_id", "mark", "lo", "hi"])

    def bucket_repeats(blobs: list[bytes]) -> pa.RecordBatch | None:
        parts_ = [unpacked(b) for b in blobs]
        null, doc, mark, first = np.concatenate([x for x, _ in parts_], axis=1)
        text = Text(b"".join(s for _, s in parts_))
        at = text.windows(p.window)
        opens = np.searchsorted(text.string, np.arange(len(doc)))
        by = np.lexsort((mark, doc, null))
        new = np.concatenate(([False], (np.diff(mark[by]) != 0) | (np.diff(doc[by]) != 0) | (np.diff(null[by]) != 0)))
        rank = np.empty(len(doc), np.int64)
        rank[by] = np.cumsum(new)
        string = text.string[at]
        place = first[string] + at - opens[string]
        flagged = np.flatnonzero(earliest(text, (rank[string] << 38) + place, at, p.window))
        if not len(flagged):
            return None
        lo, hi = spans(string[flagged], at[flagged], p.window)
        own = string[flagged[lo]]
        return told(null[own], doc[own], mark[own], place[flagged[lo]], place[flagged[hi]] + p.window)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = -1, []
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if b < 0:
                    yield told(*unpacked(blob)[0])
                    continue
                if b != bucket and held:
                    if (found := bucket_repeats(held)) is not None:
                        yield found
                    held = []
                bucket = b
                held.append(blob)
        if held and (found := bucket_repeats(held)) is not None:
            yield found

    met = texts.mapInArrow(cut, "part int, bucket int, blob binary").repartitionById(parts, F.col("part")).sortWithinPartitions("bucket")
    found = materialize(met.mapInArrow(compare, "doc_id long, mark long, lo long, hi long"), "repeats")
    return found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def drop_repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: the words that stay, joined by one space."""
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    found = repeated(named, p).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    joined = named.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                total.append(len(words))
                if spans_:
                    stays = bytearray(b"\1" * len(words))
                    for s in spans_:
                        stays[s["lo"] : s["hi"]] = bytes(s["hi"] - s["lo"])
                    words = list(compress(words, stays))
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept string")
