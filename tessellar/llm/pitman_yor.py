"""A hierarchical Pitman-Yor language model of words, spelled by restaurants over bytes.

Each word, and the end of a document before the next one's first word, is a context with a restaurant of its own; the tables it opens
are the customers of the word restaurant, which serves word types; a table that one opens sends the word's spelling to the byte
restaurants, where the context of up to three bytes names a restaurant and contexts that end alike share a parent, down to the
uniform distribution over bytes (of the bytes before the last, letters a to z are told apart and all others fall into six classes, so that the restaurants are bounded). Every word type has one table's spelling in the byte restaurants. Seating is sampled by Gibbs
sweeps over whole restaurants: given its parent's predictive probabilities, each restaurant's customers are seated again by the
Chinese-restaurant rule, and the tables they open are the parent's customers. A pair of words that occurs once has one table,
so that a sweep seats the others alone. A pair's tables, a context's tables and a word's probability are each averaged over the sweeps kept.
The contexts' discount comes from the pairs seen once and twice; their strength is, after each sweep that is not kept, the one that makes every
customer of every context, left out once, most probable. Of a pair seen once that takes its context's numbers alone, so such pairs are summed by context.

Counts cover the whole corpus. Words and pairs are counted where they lie, in blocks of BLOCK_DOCS documents, so that what is
shuffled is one row per block and distinct word; a block's pairs travel packed, in the order of their hashes, one row for each bucket of
pairs, as many as blocks. A bucket adds up its pairs: only those seen more than once become rows, those seen once are summed by word, and each block
keeps its pairs' places, by which their weights come back to the block and meet its texts. The byte restaurants are bounded by construction: at
most 2**18 with 256 dishes, so the model that is broadcast has a bounded size whatever the corpus.

Null texts are empty: they hold the end token alone. Repeated rows count as often as they occur. An empty table
gives no rows; a corpus without training rows gives the base score's smoothing and a uniform spelling.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import fold, materialize

BLOCK_DOCS = 4096
#: The end of a document; no word is empty.
END = b""


@dataclass(frozen=True)
class Sampler:
    discount: float = 0.5
    strength: float = 1.0
    word_strength: float = 10.0
    spelled: float = 0.1
    burn_in: int = 4
    keep: int = 4
    seed: int = 7
    #: Strengths of the contexts to choose from, and the first sweep's.
    context_strengths: tuple[float, ...] = (1.0, 4.0, 16.0, 64.0, 256.0, 1e3, 1e4, 1e5, 1e7)
    first_strength: float = 16.0


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A to Z alone); bytes.split() cuts at space and the controls 9 to 13."""
    return (text or b"").lower().split()


def key_of(word: bytes) -> int:
    """64 bits that stand for a word in pairs."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


_CLASS = np.array([b - 97 if 97 <= b <= 122 else 26 + b % 6 for b in range(256)], np.int64)


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of every word, 0 ending it: the byte, its restaurant and the word it belongs to.

    A restaurant's number holds the last byte (8 bits) and the classes of the two before it (5 bits each); dropping the
    lowest 5 bits gives the parent, so every restaurant has one parent and there are at most 2**18.
    """
    joined = np.frombuffer(b"".join([w + b"\0" for w in words]), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    position = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    previous = []
    for n in (1, 2, 3):
        x = np.zeros(len(joined), np.int64)
        x[n:] = joined[:-n]
        x[position < n] = 0
        previous.append(x)
    return joined, (previous[0] << 10) + (_CLASS[previous[1]] << 5) + _CLASS[previous[2]], word


def seat(customers: np.ndarray, opens: np.ndarray, discount: float, uniform) -> np.ndarray:
    """Tables after seating each entry's customers one by one: the i-th opens one with probability opens / (opens + i - discount * tables).

    uniform(i) gives numbers in (0, 1) for step i. The first 64 customers are seated singly, later ones in runs that double, by a
    rounded normal draw with the run's mean and variance.
    """
    tables = (customers > 0).astype(np.float64)
    most = int(customers.max(initial=0))
    for i in range(1, min(most, 64)):
        p = opens / (opens + i - discount * tables)
        tables += (customers > i) & (uniform(i) < p)
    low = 64
    while low < most:
        n = np.clip(customers - low, 0, low).astype(np.float64)
        p = opens / (opens + low + n / 2 - discount * tables)
        z = np.sqrt(-2 * np.log(uniform(low))) * np.cos(2 * np.pi * uniform(low + 1))
        tables += np.clip(np.rint(n * p + z * np.sqrt(n * p * (1 - p))), 0, n)
        low *= 2
    return tables


class Bytes:
    """The byte restaurants: averaged predictive log10 probabilities, one row for each restaurant seen, and a row for all others."""

    def __init__(self, rows: np.ndarray, log10: np.ndarray):
        self.row = np.zeros(1 << 18, np.int32)
        self.row[rows] = np.arange(1, len(rows) + 1)
        self.log10 = log10

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word's spelling with its end."""
        if not words:
            return np.zeros(0)
        byte, restaurant, word = spelling(words)
        return np.bincount(word, self.log10[self.row[restaurant], byte].astype(np.float64), len(words))


def sample(restaurant: np.ndarray, byte: np.ndarray, n: np.ndarray, p: Sampler) -> Bytes:
    """Gibbs sweeps over the byte restaurants. Input: customers of the longest contexts' restaurants, by byte."""
    rng = np.random.default_rng(p.seed)
    rows = np.unique(restaurant)
    shifts = (0, 5, 10, 18)  # from the longest context to none
    levels = [(restaurant >> 0, byte)]
    for a, b in zip(shifts, shifts[1:], strict=False):
        key = np.unique((levels[-1][0] >> (b - a)) * 256 + levels[-1][1])
        levels.append((key >> 8, key & 255))
    ups = [np.searchsorted(up[0] * 256 + up[1], (low[0] >> (b - a)) * 256 + low[1]) for low, up, a, b in zip(levels, levels[1:], shifts, shifts[1:], strict=False)]
    sizes = [1 << (18 - s) for s in shifts]
    parent_of = [np.full(len(x[0]), 1 / 256) for x in levels]
    open_tables = [np.bincount(x[0], minlength=k).astype(np.float64) for x, k in zip(levels, sizes, strict=True)]
    total, kept = None, 0
    for sweep in range(p.burn_in + p.keep):
        customers, seated = n.astype(np.int64), []
        for k, (r, _) in enumerate(levels):
            tables = seat(customers, (p.strength + p.discount * open_tables[k][r]) * parent_of[k], p.discount, lambda i, r=r: 1 - rng.random(len(r)))
            seated.append((customers, tables))
            open_tables[k] = np.bincount(r, tables, sizes[k])
            if k < 3:
                customers = np.bincount(ups[k], tables, len(levels[k + 1][0])).astype(np.int64)
        below = np.full((1, 256), 1 / 256)
        for k in (3, 2, 1, 0):  # predictive probabilities from the root down
            r, b = levels[k]
            parent_of[k] = below[r >> (shifts[k + 1] - shifts[k]) if k < 3 else np.zeros(len(r), np.int64), b]
            c, t = seated[k]
            sat = np.bincount(r, c, sizes[k])
            here = rows if k == 0 else np.arange(sizes[k])
            up = here >> (shifts[k + 1] - shifts[k]) if k < 3 else np.zeros(len(here), np.int64)
            probability = below[up] * ((p.strength + p.discount * open_tables[k][here]) / (sat[here] + p.strength))[:, None]
            probability[np.searchsorted(here, r), b] += (c - p.discount * t) / (sat[r] + p.strength)
            below = probability
            if k == 3:
                root = probability[0]
        if sweep >= p.burn_in:
            total, kept = (np.vstack([root, below]) + (0 if total is None else total)), kept + 1
    return Bytes(rows, np.log10(total / kept).astype(np.float32))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: numbers that depend on the word and the step alone, so that every block seats a word alike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dish(spelled: np.ndarray, types: int, p: Sampler) -> np.ndarray:
    """Probability of a new table's word: one of the vocabulary, with one place for all unknown words, or a spelled one."""
    return (1 - p.spelled) / (types + 1) + p.spelled * 10.0**spelled


def _uniform(key: np.ndarray):
    """Numbers in (0, 1) by step, from each entry's key alone."""
    return lambda i: ((_mix(key + np.array([i], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def seat_by_key(customers: np.ndarray, opens: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """seat() with the numbers of each entry's key, for entries of like size at a time: most have few customers and take few steps."""
    tables, low = np.zeros(len(customers)), 0
    for high in (1, 2, 4, 8, 16, 32, 64, np.iinfo(np.int64).max):
        at = np.flatnonzero((customers > low) & (customers <= high))
        if len(at):
            tables[at] = seat(customers[at], opens[at], discount, _uniform(key[at]))
        low = high
    return tables


def forget(written: list) -> None:
    """Drop tables that are no longer read."""
    for x in written:
        common._written.remove(x)
        common.release(*x)


def _blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, bytes, held_out, block) of every row."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), (fold(F.coalesce("doc_id", F.lit(-1)), 10) == 0).alias("held_out"), block.alias("block"))


def _count(rows: pa.Table) -> pa.Table:
    counted: Counter = Counter()
    others: set[bytes] = {END}
    ends = 0
    for text, held_out in zip(rows.column("text").to_pylist(), rows.column("held_out").to_pylist(), strict=True):
        if held_out:
            others.update(tokens_of(text))
        else:
            counted.update(tokens_of(text))
            ends += 1
    counted[END] = ends
    words = [*counted, *(others - counted.keys())]
    n = [*counted.values(), *[0] * (len(words) - len(counted))]
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()] * len(words), pa.int32()), "word": pa.array(words, pa.binary()), "key": pa.array(map(key_of, words), pa.int64()), "n": pa.array(n, pa.int64())})


def _numbered(texts: list[bytes], number: dict[bytes, int]) -> list[np.ndarray]:
    """The words of each text and its end by number; new words get the next one."""
    return [np.array([number.setdefault(w, len(number)) for w in (*tokens_of(t), END)], np.int64) for t in texts]


def _codes(at: np.ndarray, end: int) -> np.ndarray:
    """Each word's pair with the one before it, the first with the end."""
    return (np.concatenate([[end], at[:-1]]) << 32) + at


def _hashed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(u.view(np.uint64)) + w.view(np.uint64)


def _ordered(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order of pairs by their hash, then by the pair: the same wherever it is made."""
    h = _hashed(u, w)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    return np.lexsort((w, u, h)) if ((u[order[1:]] != u[order[:-1]]) & same).any() else order


def _bucket(u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that the order of pairs is also that of their buckets."""
    return (((_hashed(u, w) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pairs(rows: pa.Table, buckets: int) -> pa.Table:
    """A block's pairs in order, packed into one row for each bucket of pairs that it meets."""
    number, codes = {END: 0}, ([], [])
    for text, held_out in zip(rows.column("text"), rows.column("held_out").to_pylist(), strict=True):
        codes[held_out].append(_codes(_numbered([text.as_py()], number)[0], 0))
    keys = np.fromiter(map(key_of, number), np.int64, len(number))
    block = rows.column("block")[0].as_py()
    del number, rows
    none = np.zeros(0, np.int64)
    found, n = np.unique(np.concatenate([none, *codes[0]]), return_counts=True)
    others = np.setdiff1d(np.concatenate([none, *codes[1]]), found)
    del codes
    found, n = np.concatenate([found, others]), np.concatenate([n, np.zeros(len(others), np.int64)])
    u, w = keys[found >> 32], keys[found & 0xFFFFFFFF]
    order = _ordered(u, w)
    u, w, n = u[order], w[order], n[order]
    place = _bucket(u, w, buckets)
    met, at = np.unique(place, return_index=True)
    cut = [slice(a, b) for a, b in zip(at, [*at[1:], len(u)], strict=True)]
    packed = lambda x: pa.array([x[k].tobytes() for k in cut], pa.binary())
    out = pa.table({"bucket": pa.array(met, pa.int32()), "block": pa.array([block] * len(met), pa.int32()), "u": packed(u), "w": packed(w), "n": packed(n)})
    pa.default_memory_pool().release_unused()
    return out


_PAIRS = "kind int, bucket int, block int, u long, w long, c long, n_u long, n_w long, at binary"


def _joined(rows: pa.Table) -> pa.Table:
    """A bucket's pairs from all blocks. kind 0: pairs seen more than once; 1: by word, the pairs and those seen once that it begins (c, n_u) and those seen once that it ends (n_w); 2: by block, for each of its pairs the place among those of kind 0, -1 if it was seen once, -2 if never in training."""
    u, w, n = (np.frombuffer(b"".join(rows.column(k).to_pylist()), np.int64) for k in ("u", "w", "n"))
    sizes = [len(x) // 8 for x in rows.column("u").to_pylist()]
    order = _ordered(u, w)
    u, w = u[order], w[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    starts = np.flatnonzero(new)
    c = np.add.reduceat(n[order], starts)
    u, w = u[starts], w[starts]
    code = np.where(c > 1, np.cumsum(c > 1) - 1, c - 2).astype(np.int32)
    code[c == 1] = -1
    place = np.empty(len(order), np.int32)
    place[order] = code[np.cumsum(new) - 1]
    blocks = [x.tobytes() for x in np.split(place, np.cumsum(sizes)[:-1])]
    many, once = c > 1, c == 1
    begun = u[c > 0]
    keys, local = np.unique(np.concatenate([begun, w[once]]), return_inverse=True)
    count = lambda x, only=None: np.bincount(x, only, len(keys)).astype(np.int64)
    first, last = local[: len(begun)], local[len(begun) :]
    ends = count(first), count(first, once[c > 0].astype(np.float64)), count(last)
    bucket, none = rows.column("bucket")[0].as_py(), lambda k: pa.nulls(k, pa.int64())
    parts = [(0, pa.nulls(int(many.sum()), pa.int32()), pa.array(u[many]), pa.array(w[many]), pa.array(c[many]), *[none(int(many.sum()))] * 2, None)]
    parts.append((1, pa.nulls(len(keys), pa.int32()), pa.array(keys), none(len(keys)), *map(pa.array, ends), None))
    parts.append((2, rows.column("block").combine_chunks(), *[none(len(blocks))] * 5, pa.array(blocks, pa.binary())))
    made = []
    for kind, block, *columns, at in parts:
        k = len(block)
        made.append(pa.Table.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(np.full(k, bucket, np.int32)), block, *columns, pa.nulls(k, pa.binary()) if at is None else at], names=["kind", "bucket", "block", "u", "w", "c", "n_u", "n_w", "at"]))
    return pa.concat_tables(made)


def _values(placed: pa.Table, seated: pa.Table, discount: float, keep: int) -> pa.Table:
    """(block, bucket, values): what is left of the count of each pair of a block after its tables' discounts, in the order of pairs."""
    u, w, c, t = (seated.column(k).to_numpy() for k in ("u", "w", "c", "t_kept"))
    left = np.maximum(c - discount * t / keep, 0.0)[_ordered(u, w)]
    left = np.concatenate([left, [0.0, 1 - discount]])  # -2: no count, -1: one customer at one table
    told = [left[np.frombuffer(x, np.int32)].tobytes() for x in placed.column("at").to_pylist()]
    return pa.table({"block": placed.column("block"), "bucket": placed.column("bucket"), "p": pa.array(told, pa.binary())})


def left_out(c: np.ndarray, t: np.ndarray, sat: np.ndarray, tables: np.ndarray, parent: np.ndarray, discount: float, p: Sampler) -> np.ndarray:
    """For each strength, the log probability of all customers of pairs (c customers at t tables, in a context of `sat` at `tables`), each left out once. `parent` is the probability of a pair's word without that customer."""
    others = np.minimum(t, c - 1)
    total = np.maximum(tables - (t - others), 0)
    return np.array([(c * np.log((c - 1 - discount * others + (s + discount * total) * parent) / (sat - 1 + s))).sum() for s in p.context_strengths])


def choose_strength(seated: DataFrame, contexts: DataFrame, discount: float, p: Sampler) -> float:
    """The strength that makes all customers, left out once, most probable: from the sums that came with pairs seen more than once (l), and from contexts (c, n_u, tables) with n_u pairs seen once."""
    once = lambda s: F.col("n_u") * (F.log(s + F.lit(discount) * (F.col("tables") - 1)) - F.log(F.col("c") - 1 + F.lit(s)))
    alone = contexts.filter("n_u > 0").agg(*[F.sum(once(s)).alias(f"s{k}") for k, s in enumerate(p.context_strengths)]).first()
    told = seated.select(F.posexplode("l").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    likely = np.array([x or 0.0 for x in alone])
    for r in told:
        likely[r.k] += r.x
    return p.context_strengths[int(likely.argmax())] if likely.any() else p.context_strengths[-1]


def score(docs: DataFrame, sampler: Sampler = Sampler()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of docs; the perplexity is that of the model's score per token, the end counted."""
    spark = docs.sparkSession
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    blocked = _blocks(docs, blocks)
    counted = blocked.groupBy("block").applyInArrow(_count, "block int, word binary, key long, n long")
    of_word = Window.partitionBy("word")
    totals = counted.select("block", "word", "key", F.sum("n").over(of_word).alias("c"), (F.min("block").over(of_word) == F.col("block")).alias("first"))
    totals = materialize(totals, "lm-words")
    of_words = common._written[-1:]
    types = totals.filter("first and c > 0")
    n_tokens, n_types, once, twice = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            byte, restaurant, _ = spelling(batch.column(0).to_pylist())
            key, n = np.unique(restaurant * 256 + byte, return_counts=True)
            both = np.concatenate([seen[0], key])
            key, at = np.unique(both, return_inverse=True)
            seen = key, np.bincount(at, np.concatenate([seen[1], n]), len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen[0], pa.int64()), pa.array(seen[1], pa.int64())], names=["key", "n"])

    # at most 2**26 pairs of restaurant and byte, whatever the corpus; each task sends each pair once
    customers = types.select("word").mapInArrow(spell, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = (customers.column(k).to_numpy().astype(np.int64) for k in ("key", "n"))
    order = np.argsort(key)
    key, n = key[order], n[order]
    model = sample(key >> 8, key & 255, n, sampler)
    shared = spark.sparkContext.broadcast((model, n_tokens, n_types))

    pairs = blocked.groupBy("block").applyInArrow(lambda rows: _pairs(rows, blocks), "bucket int, block int, u binary, w binary, n binary")
    pairs = materialize(pairs.groupBy("bucket").applyInArrow(_joined, _PAIRS), "lm-pairs")
    of_pairs = common._written[-1:]
    unique = pairs.filter("kind = 0").select("bucket", "u", "w", "c")
    ends = pairs.filter("kind = 1").groupBy(F.col("u").alias("key")).agg(F.sum("n_u").alias("n_u"), F.sum("n_w").alias("n_w"), F.sum("c").cast("double").alias("tables"))
    once = pairs.filter("kind = 1").agg(F.coalesce(F.sum("n_u"), F.lit(0))).first()[0]
    twice = unique.filter("c = 2").count()
    inner = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
    strength = sampler.first_strength

    def dishes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _, types = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dish(model(batch.column(1).to_pylist()), types, sampler))], names=[*batch.schema.names, "dish"])

    state = types.select("key", "word", "c").mapInArrow(dishes_of, "key long, word binary, c long, dish double").join(ends, "key", "left").fillna(0, ["n_u", "n_w", "tables"])
    state = materialize(state.select("key", "c", "dish", "n_u", "n_w", "tables", (F.col("c") / F.lit(max(n_tokens, 1))).alias("p"), F.lit(0.0).alias("tables_kept"), F.lit(0.0).alias("p_kept")), "lm-state")
    seated = materialize(unique.withColumn("t_kept", F.lit(0.0)).withColumn("t", F.lit(0.0)), "lm-seated")
    all_tables, all_customers = float(n_types), 0.0
    for sweep in range(sampler.burn_in + sampler.keep):
        kept = float(sweep >= sampler.burn_in)

        def seat_pairs(batches: Iterator[pa.RecordBatch], sweep=sweep, kept=kept, strength=strength) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, w, c, before, tables, p, sat, c_w = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 9))
                key = _hashed(u, w) + np.uint64(sweep)
                t = seat_by_key(c, (strength + inner * tables) * p, inner, key)
                sums = [None] * len(t)
                if len(t) and not kept:  # a batch's sums stand in its first row
                    sums[0] = left_out(c, t, sat, tables, (c_w - 0.9) / (n_tokens + 0.1 * n_types), inner, sampler)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(before + kept * t), pa.array(t), pa.array(sums, pa.list_(pa.float64()))], names=["bucket", "u", "w", "c", "t_kept", "t", "l"])

        def seat_words(batches: Iterator[pa.RecordBatch], sweep=sweep, all_tables=all_tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, n, dishes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                t = seat_by_key(n, (sampler.word_strength + discount * all_tables) * dishes, discount, _mix(key.view(np.uint64)) + np.uint64(sweep))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t)], names=[*batch.schema.names, "t"])

        old = common._written[-2:]
        by = lambda name, *x: state.select(F.col("key").alias(name), *x)  # noqa: B023, E731
        seated = materialize(seated.select("bucket", "u", "w", "c", "t_kept").join(by("u", "tables", F.col("c").alias("sat")), "u").join(by("w", "p", F.col("c").alias("c_w")), "w").select("bucket", "u", "w", "c", "t_kept", "tables", "p", "sat", "c_w").mapInArrow(seat_pairs, "bucket int, u long, w long, c long, t_kept double, t double, l array<double>"), "lm-seated")
        if not kept:
            strength = choose_strength(seated, state, inner, sampler)
        both = seated.select(F.explode(F.array(F.struct(F.col("u").alias("key"), F.col("t").alias("u"), F.lit(0.0).alias("w")), F.struct(F.col("w").alias("key"), F.lit(0.0).alias("u"), F.col("t").alias("w")))).alias("x")).select("x.*")
        both = both.groupBy("key").agg(F.sum("u").alias("u"), F.sum("w").alias("w"))
        zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
        words = state.join(both, "key", "left").select("key", (F.col("n_w") + zero("w")).cast("long").alias("n"), "dish", "n_u", "n_w", (F.col("n_u") + zero("u")).alias("tables"), "tables_kept", "p_kept", F.col("c").alias("customers"))
        words = materialize(words.mapInArrow(seat_words, "key long, n long, dish double, n_u long, n_w long, tables double, tables_kept double, p_kept double, customers long, t double"), "lm-words")
        all_customers, all_tables = words.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double"), F.coalesce(F.sum("t"), F.lit(0.0))).first()
        p = (F.greatest(F.col("n") - F.lit(discount) * F.col("t"), F.lit(0.0)) + F.lit(sampler.word_strength + discount * all_tables) * F.col("dish")) / F.lit(all_customers + sampler.word_strength)
        state = words.select("key", F.col("customers").alias("c"), "dish", "n_u", "n_w", "tables", p.alias("p"), (F.col("tables_kept") + kept * F.col("tables")).alias("tables_kept"), (F.col("p_kept") + kept * p).alias("p_kept"))
        forget(old)  # the sweep before is no longer read
    new = (sampler.word_strength + discount * all_tables) / (all_customers + sampler.word_strength)
    kind = docs.schema["doc_id"].dataType

    def texts(rows: pa.Table, found: pa.Table) -> pa.Table:
        model, n_all, types = shared.value
        words, back = found.filter(pc.is_valid(found.column("word"))), found.filter(pc.is_null(found.column("word")))
        known = words.column("word").to_pylist()
        c, tables, p, key = (pc.fill_null(words.column(k), 0).to_numpy() for k in ("c", "tables", "p", "u"))
        weight = np.frombuffer(b"".join(back.sort_by("bucket").column("values").to_pylist()), np.float64)
        dishes = dish(model(known), types, sampler)
        p = np.where(c > 0, p, new * dishes)  # a word without training rows can only be a new table's
        base = np.log10((c + 0.1) / (n_all + 0.1 * (types + 1)))
        number = {w: i for i, w in enumerate(known)}
        seen = c > 0
        ats = _numbered(rows.column("text").to_pylist(), number)
        here = [_codes(at, number[END]) for at in ats]
        code = np.unique(np.concatenate(here)) if here else np.zeros(0, np.int64)
        order = _ordered(key[code >> 32], key[code & 0xFFFFFFFF])
        left = np.empty(len(code))
        left[order] = weight  # the block's pairs came back in this order
        out: list[list] = [[], [], [], []]
        for at, pair in zip(ats, here, strict=True):
            u = pair >> 32
            a = left[np.searchsorted(code, pair)]
            score = np.log10((a + (strength + inner * tables[u]) * p[at]) / (c[u] + strength))
            for column, value in zip(out, (len(at), int(seen[at].sum()), float(base[at].sum()), float(score.sum())), strict=True):
                column.append(value)
        return pa.table([rows.column("doc_id"), rows.column("held_out"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([n_all] * len(out[0]), pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], names=schema.names)

    of_seated, of_state = common._written[-2:-1], common._written[-1:]
    keep = F.lit(float(sampler.keep))
    # one after the other, and what each has read goes, so that the disk need not hold it all
    placed = pairs.filter("kind = 2").select("block", "bucket", "at")
    back = placed.groupBy("bucket").cogroup(seated.select("bucket", "u", "w", "c", "t_kept").groupBy("bucket")).applyInArrow(lambda a, b: _values(a, b, inner, sampler.keep), "block int, bucket int, p binary")
    back = materialize(back, "lm-back")
    forget(of_pairs + of_seated)
    back = back.select("block", *[F.lit(None).cast(t).alias(k) for k, t in (("word", "binary"), ("u", "long"), ("c", "long"), ("tables", "double"), ("p", "double"))], "bucket", F.col("p").alias("values"))
    words = totals.select("block", "word", "key", "c").join(state.select("key", (F.col("tables_kept") / keep).alias("tables"), (F.col("p_kept") / keep).alias("p")), "key", "left")
    words = materialize(words, "lm-known")
    forget(of_words + of_state)
    words = words.select("block", "word", F.col("key").alias("u"), "c", "tables", "p", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("values"))
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(k, T.LongType()) for k in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(k, T.DoubleType()) for k in ("base_score", "score")]
    )
    scored = blocked.groupBy("block").cogroup(words.unionByName(back).groupBy("block")).applyInArrow(texts, schema)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
