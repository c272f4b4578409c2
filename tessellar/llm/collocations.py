"""Phrases whose words keep together, mined with hashed bucket counts.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words at spaces and tabs; all counts are of
one language. Pass s counts phrases of s words exactly and adds up phrases of s + 1 words in hashed buckets, counters that stop at
`least`. A phrase is counted in the next pass only where its bucket reached `least` and both phrases of s words within it are frequent;
both tests read bitmaps of one size (a bit a bucket), which are all that is broadcast: about one bucket for two words, 2**27 at most
(16 MB). Beyond that size buckets fill, fewer phrases are ruled out before they are counted, and the result stays the same.

A frequent phrase of 2 words or more is a candidate. Cut after its first k words it has l and r, the counts of both parts, and the score
floor(10**6 * a * a / (l * r)); the cut with the lowest score counts, the shortest first part among equals. A candidate goes if a longer one
holds its words in a row and has `share` percent of its count. Of each language the `top` best are returned. Arithmetic is on decimals of
38 digits: counts up to 9 * 10**15 are exact, larger ones an error.

Null texts have no words; a null language counts as `und`; rows that repeat are counted as often; ids and other columns are not
read. Long texts are read in slices that overlap by the words a phrase may span. Words are compared as UTF-8 bytes. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, materialize, small_batches
from .repeats import mixed

#: Bytes of text handled at once, and buckets in a block of counters.
SLICE, BLOCK = 4 << 20, 1 << 16
MOST_BITS = 27
#: Groups that a language's candidates are first ranked in.
GROUPS = 64
ENDS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
KIND = np.zeros(256, np.uint8)
KIND[list(GAPS.encode())] = 1
KIND[list(ENDS.encode())] = 2
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_BREAK = re.compile(f"[{re.escape(ENDS + GAPS)}]".encode())
_END = re.compile(f"[{re.escape(ENDS)}]".encode())


@dataclass(frozen=True)
class Mining:
    longest: int = 3
    least: int = 10
    #: A candidate goes if a longer one that holds it has this percentage of its count.
    share: int = 50
    top: int = 2000


@dataclass
class Words:
    """The words of a slice in order: number in `values`, piece, and hash with the language. The first `carry` were counted before."""

    values: list[bytes]
    at: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray
    carry: int = 0
    _grams: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def of(lang: str, raw: bytes, carry: int) -> Words:
        data = np.frombuffer(raw, np.uint8)
        kind = KIND[data]
        inside = np.concatenate(([False], kind == 0, [False]))
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[kind == 0].tobytes())]).dictionary_encode()
        values = words.dictionary.to_pylist()
        salt = pd.util.hash_array(np.array([lang], dtype=object), categorize=False)
        own = mixed(pd.util.hash_array(np.array([*values, b""], dtype=object), categorize=False)[:-1] ^ salt)
        at = words.indices.to_numpy().astype(np.int64)
        return Words(values, at, np.cumsum(kind == 2)[starts], own[at], carry)

    def grams(self, size: int) -> np.ndarray:
        """Hashes of the `size` words from each word on, whether or not they stand in one piece."""
        if size == 1:
            return self.hashes
        if size not in self._grams:
            n = max(0, len(self.at) - size + 1)
            self._grams[size] = mixed(self.grams(size - 1)[:n] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[size - 1 :])
        return self._grams[size]

    def places(self, size: int) -> np.ndarray:
        """First words of all phrases of `size` words within a piece that are not counted yet."""
        n = max(0, len(self.at) - size + 1)
        here = self.piece[:n] == self.piece[size - 1 :]
        here[: max(0, self.carry - size + 1)] = False
        return np.flatnonzero(here)

    def counted(self, places: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray]:
        """The distinct phrases at `places`, and how often each stands there."""
        group = self.at[places]
        for k in range(1, size):
            group = np.unique(group * len(self.values) + self.at[places + k], return_inverse=True)[1]
        _, first, n = np.unique(group, return_index=True, return_counts=True)
        parts = [self.at[places[first] + k].tolist() for k in range(size)]
        return [b" ".join([self.values[i] for i in ids]) for ids in zip(*parts)], n


def slices(batches: Iterator[pa.RecordBatch], p: Mining) -> Iterator[tuple[str, Words]]:
    """(language, words) of about SLICE bytes; a longer text is cut between words and takes the words before the cut along."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode().translate(LOWER)
            if len(raw) <= SLICE:
                held[lang].append(raw)
                size += len(raw)
            else:
                at, before = 0, []
                while at < len(raw):
                    found = _BREAK.search(raw, at + SLICE)
                    end = found.end() if found else len(raw)
                    part = b" ".join([*before, raw[at:end]])
                    yield lang, Words.of(lang, part, len(before))
                    before = _END.split(part)[-1].split(b" ") if p.longest > 1 else []
                    before = [w for x in before for w in x.split(b"\t") if w][1 - p.longest :]
                    at = end
            if size >= SLICE:
                yield from ((k, Words.of(k, b"\n".join(v), 0)) for k, v in held.items())
                held, size = defaultdict(list), 0
    yield from ((k, Words.of(k, b"\n".join(v), 0)) for k, v in held.items())


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


class Buckets:
    """Counters that stop at `most`."""

    def __init__(self, bits: int, most: int):
        self.most, self.mask, self.counts = most, np.uint64((1 << bits) - 1), np.zeros(1 << bits, np.uint8 if most < 256 else np.int64)

    def add(self, hashes: np.ndarray, n: int = 1) -> None:
        at, times = np.unique(hashes & self.mask, return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + times * n, self.most)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        for lo in range(0, len(self.counts), BLOCK):
            part = self.counts[lo : lo + BLOCK]
            if part.any():
                yield lo // BLOCK, zstandard.compress(part.tobytes(), 1)


COUNTS = "lang string, phrase string, n long, block int, counters binary"


def _counts(lang: str, phrases: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    size = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], ["lang", "phrase", "n", "block", "counters"])


def _blocks(buckets: Buckets) -> Iterator[pa.RecordBatch]:
    for block, counters in buckets.blocks():
        none = [pa.nulls(1, k) for k in (pa.string(), pa.string(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([block], pa.int32()), pa.array([counters], pa.binary())], ["lang", "phrase", "n", "block", "counters"])


def bitmap(rows: DataFrame, bits: int, most: int) -> np.ndarray:
    """One bit for each bucket, set where the counters of all tasks (block, counters) reach `most` together."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = ((b, c) for batch in batches for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for block, group in groupby(rows_, key=lambda r: r[0]):
            total = 0
            for _, counters in group:
                total = np.minimum(np.frombuffer(zstandard.decompress(counters), np.uint8 if most < 256 else np.int64).astype(np.int64) + total, most)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= most, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    met = rows.filter(F.col("block").isNotNull()).select("block", "counters").repartition("block").sortWithinPartitions("block")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in met.mapInArrow(merge, "block int, bits binary").toLocalIterator():
        out[r.block * BLOCK // 8 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def grams(texts: DataFrame, p: Mining = Mining()) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n): words of each language; and for each size (lang, phrase, f): the phrases that occur `least` times. texts: lang, text without nulls."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(BLOCK.bit_length() - 1, (size // 12).bit_length()))

    def counting(s: int, frequent: np.ndarray | None, reached: np.ndarray | None):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            buckets = Buckets(bits, p.least)
            for lang, words in slices(batches, p):
                if not len(words.at):
                    continue
                places, longer = words.places(s), words.places(s + 1)
                if frequent is not None:
                    # candidates among all places, counted before or not: the next size asks for two of them
                    likely = has(reached, words.grams(s))
                    known = has(frequent, words.grams(s - 1))
                    likely &= known[: len(likely)] & known[1 : len(likely) + 1]
                    places, longer = places[likely[places]], longer[likely[longer] & likely[longer + 1]]
                phrases, n = words.counted(places, s)
                yield _counts(lang, phrases, n)
                if s < p.longest:
                    buckets.add(words.grams(s + 1)[longer])
            if s < p.longest:
                yield from _blocks(buckets)

        return task

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets of frequent phrases, as full counters."""
        buckets = Buckets(bits, p.least)
        for batch in batches:
            for lang, rows in pd.DataFrame({"lang": batch.column(0).to_pylist(), "phrase": batch.column(1).to_pylist()}).groupby("lang"):
                text = "\n".join(rows["phrase"]).encode()
                words = Words.of(lang, text, 0)
                width = rows["phrase"].iloc[0].count(" ") + 1
                buckets.add(words.grams(width)[words.places(width)], p.least)
        yield from _blocks(buckets)

    frequent = reached = total = None
    out = []
    for s in range(1, p.longest + 1):
        rows = materialize(texts.select("lang", "text").mapInArrow(counting(s, frequent, reached), COUNTS), f"grams{s}", compression="zstd")
        phrases = rows.filter(F.col("block").isNull())
        if s == 1:
            total = phrases.groupBy("lang").agg(F.sum("n").alias("n"))
        out.append(materialize(phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= p.least), f"frequent{s}"))
        if s < p.longest:
            reached = bitmap(rows, bits, p.least)
            frequent = bitmap(out[-1].select("lang", "phrase").mapInArrow(hashed, COUNTS), bits, p.least)
    return total, out


def mine(docs: DataFrame, p: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total, sizes = grams(texts, p)
    known, candidates = sizes[0], sizes[1]
    for more in sizes[1:]:
        known = known.union(more)
    for more in sizes[2:]:
        candidates = candidates.union(more)
    words = candidates.withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))

    cut = words.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("rest"))
    side = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    if p.longest > 2:
        # every shorter run of words within a candidate, with the largest count of those that hold it
        runs = words.filter(F.size("w") > 2).select("lang", "a", "w", F.explode(F.expr("sequence(2, size(w) - 1)")).alias("s"))
        runs = runs.select("lang", "a", F.explode(F.expr("transform(sequence(1, size(w) - s + 1), i -> array_join(slice(w, i, s), ' '))")).alias("phrase"))
        held = runs.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        scored = scored.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < p.share * F.col("a")))

    flat = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)).alias("group"))
    best_first = [F.desc("score"), F.desc("a"), F.col("phrase")]
    for keys in (["lang", "group"], ["lang"]):
        flat = flat.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first)).cast("long")).filter(F.col("rank") <= p.top)
    return flat.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
