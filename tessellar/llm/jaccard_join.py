"""Similarity join on sets of word shingles, by signature trees under rare tokens, with connected components.

Two texts link when `percent` of the union of their shingle sets lies in the intersection. Equal sets are one class from
the start. A link needs a common token among the rarest tokens of both sets (the prefix: all but as many as must be shared,
less one), under any order of tokens that all share; the order here is by a count-min sketch of the corpus
(fixed width, merged by sums), so passages that many texts hold come last and name no group. The classes under a
token form a group. First each class is compared with a few of its groups' members, chosen by hash, which connects
families of near copies in linear work. Where a group still spans several components, a signature tree is built over it: nodes
hold OR-combined bitmaps and size ranges, a dual traversal drops pairs of nodes whose largest possible overlap is
too small or which lie in one component, and what is left is compared exactly. Large groups are dealt out as
pairs of blocks. No link is lost: only pairs that cannot link or are connected already are passed over.

Null texts and texts without words have no shingles, link with nothing and are their own component. Repeated rows and ids are
one class. An empty table gives no rows. Other columns are not read. A null doc_id never names a component unless alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

SLOT_BITS, CHUNKS = 20, 64
BLOCK = 1000
LEAF, FAN = 4, 8
#: Classes that a task remembers, and rows that it holds at once.
MOST_SEEN, SLICE = 100_000, 512
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class Join:
    width: int = 3
    percent: int = 90
    pivots: int = 4
    broadcast_rows: int = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text whose words are hashed at once; a text may be longer.
PIECE = 1 << 18
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.int64)
_NEAR = mix(np.arange(64 * 256, dtype=np.uint64) * _K[0])


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes starts, and its 64-bit hash: the mixed sum of a mixed number for each letter at its place."""
    letter = ~_SPACE[data]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    first = starts[0]
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    code = place * 256 + _LOWER[data[first:]]
    part = _NEAR[np.minimum(code, len(_NEAR) - 1)]
    far = np.flatnonzero(code >= len(_NEAR))
    part[far] = mix(code[far].astype(np.uint64) * _K[0])
    part[~letter[first:]] = 0
    return starts, mix(np.add.reduceat(part, starts - first))


class Shingler:
    """Sorted distinct 64-bit hashes of each text's shingles; a text with fewer words is one shingle. Words are hashed in bulk, PIECE bytes at a time."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        part, size = [], 0
        for text in texts:
            part.append(text or b"")
            size += len(part[-1]) + 1
            if size >= PIECE:
                yield from self._cut(part)
                part, size = [], 0
        yield from self._cut(part)

    def _hashes(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        data, lo, out = np.frombuffer(joined, np.uint8), 0, []
        while lo < len(data):  # cut at white space, so that no word is torn
            hi = min(lo + PIECE, len(data))
            while hi < len(data) and not _SPACE[data[hi]]:
                hi += 1
            starts, h = _words(data[lo:hi])
            out.append((starts + lo, h))
            lo = hi
        return np.concatenate([x for x, _ in out]), np.concatenate([h for _, h in out])

    def _cut(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        starts, h = self._hashes(b" ".join(texts) + b" ")
        edges = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]])).tolist()
        whole = self._rolled(h, self.width) if len(h) >= self.width else h[:0]
        for lo, hi in zip(edges, edges[1:], strict=False):
            n = min(self.width, hi - lo)
            if not n:
                yield np.zeros(0, np.uint64)
                continue
            s = np.sort(whole[lo : hi - n + 1] if n == self.width else self._rolled(h[lo:hi], n))
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]

    @staticmethod
    def _rolled(h: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(h) - n + 1, np.uint64(n) * _K[2], np.uint64)
        for i in range(n):
            out = mix(out * _K[0] + h[i : len(h) - n + 1 + i] * _K[1])
        return out


def name_of(tokens: np.ndarray) -> bytes:
    """A class's name: 128 bits of its set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """Every row with a key that is never null; rows that share it have the same id and text (or are told apart by their class)."""
    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), F.xxhash64("doc_id", "text").alias("key"))


def _classes(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, key, n, class, bits) of each row, and rows (chunk, bits) with each task's part of the sketch."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts, id_type = Shingler(join.width), np.zeros(1 << SLOT_BITS, np.uint32), None
        for batch in slices(batches):
            id_type, n, name, bits = batch.column(0).type, [], [], []
            for s in shingle(batch.column(1).to_pylist()):
                np.add.at(counts, _slots(s), np.uint32(1))
                n.append(len(s))
                name.append(name_of(s))
                bits.append(bitmap(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.nulls(len(n), pa.int32()), pa.array(bits, pa.binary())], names=schema.names)
        if id_type is not None:
            parts = [x.tobytes() for x in np.split(counts, CHUNKS)]
            long = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, id_type), long, long, pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=schema.names)

    fields = [("key", T.LongType()), ("n", T.LongType()), ("class", T.BinaryType()), ("chunk", T.IntegerType()), ("bits", T.BinaryType())]
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(k, t) for k, t in fields]])
    return _texts(docs).mapInArrow(run, schema)


def _sketch(parts: DataFrame) -> np.ndarray:
    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in rows.column("bits").to_pylist())
        return pa.table({"chunk": rows.column("chunk")[:1], "bits": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    found = parts.groupBy("chunk").applyInArrow(add, "chunk int, bits binary").collect()  # CHUNKS rows, 4 MB in all
    out = np.zeros((CHUNKS, (1 << SLOT_BITS) // CHUNKS), np.uint32)
    for r in found:
        out[r.chunk] = np.frombuffer(r.bits, np.uint32)
    return out.ravel()


def _postings(docs: DataFrame, sketch: np.ndarray, join: Join) -> DataFrame:
    """(token, class, n): the prefix of each set."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts, seen = Shingler(join.width), shared.value, set()
        for batch in slices(batches):
            token, name, size = [np.zeros(0, np.uint64)], [], []
            if len(seen) > MOST_SEEN:
                seen.clear()
            for s in shingle(batch.column(1).to_pylist()):
                own = name_of(s)
                if len(s) and own not in seen:
                    seen.add(own)
                    token.append(rarest(s, counts, prefix_length(len(s), join.percent)))
                    name.append(own)
                    size.append(len(s))
            per = np.array([len(x) for x in token[1:]], np.int64)
            names = pa.array(name, pa.binary()).take(pa.array(np.repeat(np.arange(len(per)), per)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), names, pa.array(np.repeat(np.array(size, np.int32), per))], names=["token", "class", "n"])

    # one exchange by the token serves the removal of copies and all windows over groups
    return _texts(docs).mapInArrow(run, "token long, class binary, n int").repartition("token").dropDuplicates(["token", "class"])


def rarest(tokens: np.ndarray, counts: np.ndarray, p: int) -> np.ndarray:
    """The first p of sorted tokens in the order of (count, token)."""
    n = counts[_slots(tokens)]
    last = np.partition(n, p - 1)[p - 1]
    less = tokens[n < last]
    return np.concatenate([less, tokens[n == last][: p - len(less)]])


def _sets(docs: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """(class, n, tokens) of the rows with the wanted keys, once for each class."""
    few = wanted.count() <= join.broadcast_rows
    chosen = _texts(docs).join(F.broadcast(wanted.select("key")) if few else wanted.select("key"), "key", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(join.width)
        for batch in slices(batches):
            sets = list(shingle(batch.column(0).to_pylist()))
            tokens = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(map(name_of, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), tokens], names=["class", "n", "tokens"])

    return chosen.mapInArrow(run, "class binary, n long, tokens array<long>").dropDuplicates(["class"])


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit per token in a bitmap of 64-bit words, at least twice as many bits as tokens (a power of two)."""
    bits = 256
    while bits < 2 * len(tokens) and bits < 1 << 20:
        bits *= 2
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def narrow(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same tokens would have at a smaller width."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), 0) if len(bits) > words else bits


class Node:
    """OR-combined bitmap, range of sizes, most tokens beyond the bits set, and the component if there is only one."""

    def __init__(self, children: list[Node]):
        self.children = children
        words = min(len(c.bits) for c in children)
        self.bits = np.bitwise_or.reduce([narrow(c.bits, words) for c in children])
        self.low, self.high = min(c.low for c in children), max(c.high for c in children)
        self.extra = max(c.extra_at(words) for c in children)
        names = {c.component for c in children}
        self.component = names.pop() if len(names) == 1 else None

    def extra_at(self, words: int) -> int:
        return self.extra if len(self.bits) <= words else self.high


class Leaf(Node):
    def __init__(self, name: bytes, n: int, bits: np.ndarray, component: bytes):
        self.name, self.low, self.high, self.bits, self.component, self.children = name, n, n, bits, component, []
        self.extra = n - int(np.bitwise_count(bits).sum())

    def extra_at(self, words: int) -> int:
        return self.high - int(np.bitwise_count(narrow(self.bits, words)).sum()) if len(self.bits) > words else self.extra


def tree(leaves: list[Leaf]) -> Node:
    level: list[Node] = sorted(leaves, key=lambda x: (x.component, x.low, x.name))
    fan = LEAF
    while len(level) > 1:
        level, fan = [Node(level[i : i + fan]) for i in range(0, len(level), fan)], FAN
    return level[0]


def may_link(a: Node, b: Node, percent: int) -> bool:
    """Whether the largest possible overlap of a set under a with one under b reaches the share."""
    if a.component is not None and a.component == b.component:
        return False
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    words = min(len(a.bits), len(b.bits))
    most = min(a.extra_at(words), b.extra_at(words)) + int(np.bitwise_count(narrow(a.bits, words) & narrow(b.bits, words)).sum())
    return (100 + percent) * most >= percent * (a.low + b.low)


def traverse(a: Node, b: Node, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of leaves that the bounds leave over; a and b may be the same node."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x is y:
            stack += [(c, d) for i, c in enumerate(x.children) for d in x.children[i:] if c is not d or c.children]
        elif may_link(x, y, percent):
            if not x.children and not y.children:
                yield (x.name, y.name)
            elif not y.children or (x.children and x.high >= y.high):
                stack += [(c, y) for c in x.children]
            else:
                stack += [(x, d) for d in y.children]


def _verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of classes that link; sets meet their pairs by two joins on the class, and built-in functions compare them."""
    one = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.filter(100 * F.col("common") >= join.percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(class, component): the smallest name reachable, by rounds of taking the smallest neighbour's and jumping to its own."""
    both = materialize(links.union(links.select("b", "a")).distinct(), "links")
    label = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "class"), "labels")
    while True:
        near = both.join(label.select(F.col("class").alias("b"), "component"), "b").groupBy(F.col("a").alias("class")).agg(F.min("component").alias("near"))
        moved = label.join(near, "class").select("class", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jumped = moved.join(moved.select(F.col("class").alias("next"), F.col("next").alias("far")), "next", "left").select("class", F.least("next", F.coalesce("far", "next")).alias("component"), "was")
        jumped = materialize(jumped, "labels")
        label = jumped.select("class", "component")
        if jumped.filter("component <> was").isEmpty():
            return label


def _possible(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of classes whose bitmaps leave room for a link."""
    side = lambda k: classes.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = lambda row, k: Leaf(row[k], row["n" + k], np.frombuffer(row["bits" + k], np.uint64), row[k])
            keep = [may_link(leaf(row, "a"), leaf(row, "b"), join.percent) for row in batch.to_pylist()]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def link(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    return grouped(docs, join).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, key, n_shingles, component, component_id) of each row: `key` is xxhash64(doc_id, text), `component` names the group even where no row has an id."""
    small_batches(docs.sparkSession)
    first = materialize(_classes(docs, join), "jaccard-classes")
    rows = first.filter("chunk is null").select("doc_id", "key", "n", "class")
    # the bitmaps of a class's copies are equal
    classes = first.filter("chunk is null and n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialize(classes, "jaccard-members")
    sketch = _sketch(first.filter("chunk is not null").select("chunk", "bits"))
    # a group falls apart where sizes in order leave a gap that no link can span
    by_size = Window.partitionBy("token").orderBy("n", "class")
    gap = F.coalesce((100 * F.lag("n").over(by_size) < join.percent * F.col("n")).cast("int"), F.lit(0))
    shared = _postings(docs, sketch, join).withColumn("gap", gap).withColumn("part", F.sum("gap").over(by_size))
    group = Window.partitionBy("token", "part")
    pivot = group.orderBy(F.xxhash64("class", F.pmod("token", F.lit(join.pivots))), "class")
    shared = shared.withColumn("members", F.count("*").over(group)).filter("members > 1")
    shared = shared.withColumns({"pivot": F.first("class").over(pivot), "pn": F.first("n").over(pivot)}).drop("gap")
    shared = materialize(shared, "jaccard-shared")
    sized = (100 * F.col("n") >= join.percent * F.col("pn")) & (100 * F.col("pn") >= join.percent * F.col("n"))
    pairs = shared.filter(sized & (F.col("class") != F.col("pivot"))).select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()
    pairs = materialize(_possible(pairs, classes, join), "jaccard-pairs")
    ids = classes.select("class", "key")
    sets_of = lambda p: materialize(_sets(docs, ids.join(p.select(F.col("a").alias("class")).union(p.select("b")).distinct(), "class", "left_semi"), join), "jaccard-sets")
    links = materialize(_verified(pairs, sets_of(pairs), join), "jaccard-links")
    label = components(links)
    # groups that still span several components
    left = shared.filter("members > 2").join(label, "class", "left").select("token", "part", "class", "members", F.coalesce("component", "class").alias("component"))
    left = left.withColumns({"x": F.min("component").over(group), "y": F.max("component").over(group)}).filter("x <> y")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = left.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("token", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "component")
    dealt = materialize(dealt, "jaccard-dealt")
    keys = ["token", "part", "i", "j"]

    def sides_of(rows: pa.Table) -> tuple[dict[int, list[Leaf]], int, int]:
        sides: dict[int, list[Leaf]] = {}
        for own, name, n, bits, component in zip(*(rows.column(k).to_pylist() for k in ("own", "class", "n", "bits", "component")), strict=True):
            sides.setdefault(own, []).append(Leaf(name, n, np.frombuffer(bits, np.uint64), component))
        return sides, rows.column("i")[0].as_py(), rows.column("j")[0].as_py()

    def pairs_under(rows: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        sides, i, j = sides_of(rows)
        if i in sides and j in sides:
            a = tree(sides[i])
            yield from traverse(a, a if i == j else tree(sides[j]), join.percent)

    def trees(rows: pa.Table) -> pa.Table:
        """The pairs that the bounds leave over; a null pair if they are many, and the block's sets must be compared where they are."""
        found: list[tuple[bytes, bytes]] = []
        for pair in pairs_under(rows):
            found.append(pair)
            if len(found) > 2 * rows.num_rows:
                found = [(None, None)]
                break
        fixed = [rows.column(k)[:1].to_pylist() * len(found) for k in keys]
        ordered = [(min(x), max(x)) if x[0] is not None else x for x in found]
        return pa.table({"a": pa.array([x[0] for x in ordered], pa.binary()), "b": pa.array([x[1] for x in ordered], pa.binary())} | {k: pa.array(v, rows.schema.field(k).type) for k, v in zip(keys, fixed, strict=True)})

    def exact(rows: pa.Table) -> pa.Table:
        """Links that join components, found by comparing the sets of the pairs left over; connected components are passed over."""
        sets = dict(zip(rows.column("class").to_pylist(), (np.array(x.as_py(), np.int64) for x in rows.column("tokens")), strict=True))
        up = dict(zip(rows.column("class").to_pylist(), rows.column("component").to_pylist(), strict=True))

        def root(x: bytes) -> bytes:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        found = []
        for a, b in pairs_under(rows):
            x, y = root(a), root(b)
            if x == y:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common >= join.percent * (len(sets[a]) + len(sets[b]) - common):
                found.append((min(a, b), max(a, b)))
                up[max(x, y)], up[min(x, y)] = min(x, y), min(x, y)
        return pa.table({"a": pa.array([x[0] for x in found], pa.binary()), "b": pa.array([x[1] for x in found], pa.binary())})

    more = dealt.join(classes.select("class", "n", "bits"), "class").groupBy(*keys).applyInArrow(trees, "a binary, b binary, token long, part long, i int, j int")
    more = materialize(more, "jaccard-more")
    few = more.filter("a is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    heavy = dealt.join(more.filter("a is null").select(*keys), keys, "left_semi")
    late = [few, heavy.select(F.col("class").alias("a"), F.col("class").alias("b"))]
    if not more.isEmpty():
        sets = sets_of(late[0].union(late[1]))
        full = heavy.join(classes.select("class", "n", "bits"), "class").join(sets.select("class", "tokens"), "class")
        found = full.groupBy(*keys).applyInArrow(exact, "a binary, b binary")
        label = components(links.union(_verified(few, sets, join)).union(found))
    # a group's copies are one row here; what is left to the join with all rows is one row a class
    named = classes.select("class", "doc_id").join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.drop("doc_id").join(smallest, "component")
    out = rows.join(named, "class", "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
