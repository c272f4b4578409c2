"""Byte-level BPE by Spark higher-order functions: ranked merges are folded over the bytes of distinct words.

Texts are cut into words once: a block of texts becomes sequences of word numbers and a list of its distinct words, dealt to
buckets by a hash of the word. Those are written, in buckets by block. A bucket's words, from all blocks, are folded once for the whole
corpus: Spark's higher-order functions merge arrays of byte values with the rank map as a constant. The ids go
back to the blocks that hold the words and take the words' places in the texts. What is exchanged is one list a block and bucket, so
a word in every text is one entry a block, and buckets grow in number with the corpus, not in size. Decoding concatenates the ids'
binary pieces with Spark functions, from a literal table of them.

Null texts count as empty and give no ids. Repeated rows and ids are encoded row by row. Invalid input does not
exist for a byte-level vocabulary. Other columns pass through; `ids`, `id_list` (and `decoded`) replace columns so named.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

#: Characters of a block of texts, and for each bucket of words.
BLOCK_CHARS, BUCKET_CHARS = 32_000_000, 8_000_000
#: Longer words are merged with a heap instead of the fold, whose work grows with the square of the length.
LONG_WORD = 96
WORDS_A_ROW, WORD_ROWS = 4096, 64
#: Texts handled at once.
SLICE = 256
#: A pair can take two places in the rank map: (pair * factor div 2**24) % _SLOTS for each factor.
_SLOTS = 524_287
_FACTORS = (1_041_204_193, 878_350_721)
#: Stands for the rank of a pair that no merge has.
_NO_PAIR = 1 << 20
_BREAK = re.compile(r" (?:\s|$)")
_UNIT = re.compile(r" (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file; the rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> np.ndarray:
    """The rank map as an array: the pair of ids (a, b) lies in one of two slots, as pair * 65536 + merged id."""
    entries = {}
    for word, rank in ranks.items():
        for i in range(1, len(word)):
            if (a := ranks.get(word[:i])) is not None and (b := ranks.get(word[i:])) is not None:
                entries[a * 65536 + b] = rank
    slots = np.full(_SLOTS, -1, np.int64)
    for key, rank in entries.items():
        item, at = key * 65536 + rank, (key * _FACTORS[0] >> 24) % _SLOTS
        for _ in range(500):
            item, slots[at] = int(slots[at]), item
            if item < 0:
                break
            k = item // 65536
            one, two = ((k * f >> 24) % _SLOTS for f in _FACTORS)
            at = two if at == one else one
        else:
            raise ValueError("no place for a pair of ids; choose other factors")
    return slots


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the lowest rank merges first, the leftmost of equals; a whole word that has a rank is one id."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if mid <= i or mid >= n or end[mid] != stop:
            continue  # one of the two parts has been merged meanwhile
        end[i], end[mid] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(word[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def units(text: str) -> list[str]:
    """Cut before each space that precedes a non-space: no match of the pattern spans such a place."""
    return _UNIT.split(text) if _BREAK.search(text) else text.split(" ")


def _numbers() -> dict[str, int]:
    """A dictionary that gives each new key the next number."""
    return defaultdict(count().__next__)


class _Block:
    """The texts of a block as sequences of word numbers, and its distinct words by bucket."""

    def __init__(self, find: Callable[[str], list[str]]):
        self.find, self.heads, self.tails, self.of, self.chars = find, _numbers(), _numbers(), [], 0

    def add(self, text: str | None) -> None:
        if not text:
            self.of.append((-1, np.zeros(0, np.int32)))
            return
        first, *rest = units(text)
        self.of.append((self.heads[first], np.fromiter(map(self.tails.__getitem__, rest), np.int32, len(rest))))
        self.chars += len(text)

    def cut(self, buckets: int) -> tuple[list[np.ndarray], np.ndarray, list[tuple[int, list[bytes]]]]:
        """The texts as numbers of words, the bucket of each word by number, and the words of each bucket in the order of their numbers."""
        number, n = _numbers(), len(self.heads)
        heads = [self.find(u) for u in self.heads]
        # units joined are cut where they join, so that one search finds the words of all
        stops = np.cumsum(np.fromiter(map(len, self.tails), np.int64, len(self.tails)) + 1)
        joined = " " + " ".join(self.tails) if self.tails else ""
        self.heads, self.tails = _numbers(), _numbers()
        words = self.find(joined)
        del joined
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        size = np.concatenate([np.fromiter(map(len, heads), np.int64, n), np.diff(np.searchsorted(ends, stops, "right"), prepend=0)])
        words = [*chain.from_iterable(heads), *words]
        flat = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        words = [w.encode() for w in number]
        del number
        start, sequences, times = np.cumsum(size) - size, [], np.zeros(len(words), np.int64)
        for i in range(0, len(self.of), SLICE):
            for head, rest in self.of[i : i + SLICE]:
                at = np.concatenate([[head], rest + n]) if head >= 0 else rest
                sequences.append(_gather(flat, start[at], size[at]))
            times += np.bincount(np.concatenate(sequences[i:]), minlength=len(words))
        self.of.clear()
        # frequent words get small numbers, which take less room
        order = np.argsort(-times, kind="stable")
        number_of = np.empty(len(words), np.int32)
        number_of[order] = np.arange(len(words), dtype=np.int32)
        words = [words[i] for i in order.tolist()]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
        lists = [(int(bucket[by_bucket[lo]]), [words[i] for i in by_bucket[lo:hi].tolist()]) for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)], strict=True)]
        for i, x in enumerate(sequences):
            sequences[i] = number_of[x]
        return sequences, bucket, lists


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, the low ones first: high planes are mostly zeros."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin at `start` and have `size` entries, one behind the other."""
    if not len(size):
        return flat[:0]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]


def _cut(pattern: str, text_at: int, keep: list[int], buckets: int, schema: T.StructType) -> Callable:
    """Blocks of texts to rows of documents and rows of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        task, blocks = TaskContext.get().partitionId(), 0
        block, held = _Block(find), []

        def rows() -> Iterator[pa.RecordBatch]:
            name = (task << 24) + blocks
            sequences, bucket, words = block.cut(buckets)
            at = 0
            for batch in held:
                n = batch.num_rows
                packed = pa.array([_packed(x) for x in sequences[at : at + n]], pa.binary())
                at += n
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, name)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.binary())), packed], names=schema.names)
            words.append((None, [_packed(bucket)]))  # stays with the texts
            for lo in range(0, len(words), WORD_ROWS):
                part = words[lo : lo + WORD_ROWS]
                n = len(part)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(n, f) for f in kinds], pa.array(np.full(n, name)), pa.array([x for x, _ in part], pa.int32()), pa.array([w for _, w in part], pa.list_(pa.binary())), pa.nulls(n, pa.binary())], names=schema.names)

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in keep]
            for text in batch.column(text_at).to_pylist():
                block.add(text)
            held.append(batch.select(keep))
            if block.chars >= BLOCK_CHARS:
                yield from rows()
                block, held, blocks = _Block(find), [], blocks + 1
        if held:
            yield from rows()

    return run


def _short(rows: pa.Table) -> list[list[bytes]]:
    """The words of a bucket, once each and in order, some thousands a part; long words are left out."""
    lists = rows.column("_bpe_words").to_pylist()
    order = np.argsort(rows.column("_bpe_block").to_numpy()).tolist()  # rows come in any order
    words = [w for w in dict.fromkeys(chain.from_iterable(lists[i] for i in order)) if len(w) <= LONG_WORD]
    return [words[i : i + WORDS_A_ROW] for i in range(0, len(words), WORDS_A_ROW)]


def _distinct(rows: pa.Table) -> pa.Table:
    """The parts as arrays of words, arrays of byte values."""
    parts, lists = _short(rows), [pa.array([], pa.list_(pa.int32()))]
    for part in parts:
        ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(part), np.uint8).astype(np.int32))))
    bucket = rows.column("_bpe_bucket")[0].as_py()
    ends = pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))
    letters = pa.ListArray.from_arrays(ends, pa.concat_arrays(lists))
    return pa.table({"_bpe_bucket": pa.array([bucket] * len(parts), pa.int32()), "_bpe_part": pa.array(range(len(parts)), pa.int32()), "_bpe_letters": letters})


def _spread(ranks: dict[bytes, int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The folded words of a bucket back to the blocks that hold them, in the order of the block's words."""

    def run(asked: pa.Table, folded: pa.Table) -> pa.Table:
        number, ids, sizes = {}, [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        merged = dict(zip(folded.column("_bpe_part").to_pylist(), folded.column("_bpe_ids"), strict=True))
        for i, part in enumerate(_short(asked)):
            number.update(zip(part, range(len(number), len(number) + len(part)), strict=True))
            ids.append(merged[i]["flat"].values.to_numpy().astype("<u4"))
            sizes.append(merged[i]["sizes"].values.to_numpy().astype(np.int64))

        lists = asked.column("_bpe_words").to_pylist()
        # a whole word that has a rank is one id
        others = {w: [ranks[w]] for w in number if w in ranks} | {w: merge(w, ranks) for words in lists for w in words if len(w) > LONG_WORD}
        number.update(zip(others, range(len(number), len(number) + len(others)), strict=True))
        ids += [np.array(x, "<u4") for x in others.values()]
        sizes.append(np.fromiter(map(len, others.values()), np.int64, len(others)))
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        start = np.cumsum(size) - size
        out, packed = [], []
        for words in lists:
            at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            out.append(size[at])
            packed.append(_packed(_gather(flat, start[at], size[at])))
        return pa.table({"_bpe_block": asked.column("_bpe_block"), "_bpe_bucket": asked.column("_bpe_bucket"), "_bpe_sizes": pa.array(map(_packed, out), pa.binary()), "_bpe_flat": pa.array(packed, pa.binary())})

    return run


def _assemble(names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's sequences of word numbers to ids."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        apart = texts.column("_bpe_words").is_valid()
        bucket = _unpacked(texts.filter(apart).column("_bpe_words")[0][0].as_py())
        texts, found = texts.filter(pc.invert(apart)), found.sort_by("_bpe_bucket")
        join = lambda k: np.concatenate([np.zeros(0, "<u4"), *map(_unpacked, found.column(k).to_pylist())])
        listed, flat = join("_bpe_sizes").astype(np.int64), join("_bpe_flat")
        # what is listed by bucket and number, by number
        place = np.argsort(bucket, kind="stable")
        size, start = np.empty_like(listed), np.empty_like(listed)
        size[place], start[place] = listed, np.cumsum(listed) - listed
        out = []
        for batch in texts.combine_chunks().to_batches(SLICE):
            ids = []
            for x in batch.column("_bpe_seq"):
                at = _unpacked(x.as_py())
                ids.append(_gather(flat, start[at], size[at]))
            ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([flat[:0], *ids]).view("<i4")))
            out.append(pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([x.tobytes() for x in ids], pa.binary()), lists], names=[*names, "ids", "id_list"]))
        return pa.Table.from_batches(out)

    return run


def fold(word: str, table: str, letters: str, pairs: str) -> str:
    """SQL for the ids of a word, an array of byte values: one merge of the lowest rank, leftmost first, in each step.

    The state is an array of numbers: the rank of the pair that an id makes with the next one, times 65536, plus the id. Its smallest
    element is the next merge, and a step looks up only the two pairs that the merge makes. `letters` has the ids of single bytes, `pairs`
    the ranks of two.
    """
    none = f"{_NO_PAIR}L"
    slot = lambda f: f"{table}[cast((k * {f} div 16777216) % {_SLOTS} as int)]"
    hit = lambda f: f"transform(array({slot(f)}), e -> case when e div 65536 = k then e % 65536 end)[0]"
    element = lambda one, two: f"transform(array(({one}) * 65536 + {two}), k -> coalesce({hit(_FACTORS[0])}, {hit(_FACTORS[1])}, {none}) * 65536 + k div 65536)[0]"
    first = f"transform({word}, (x, i) -> case when i < size({word}) - 1 then coalesce(cast({pairs}[x * 256 + {word}[i + 1]] as bigint), {none}) else {none} end * 65536 + {letters}[x])"
    merged = f"case when p + 1 < size(v) then {element('b', 'v[p + 1] % 65536')} else {none} * 65536 + b end"
    inner = f"concat(slice(v, 1, p - 2), array({element('v[p - 2] % 65536', 'b')}, {merged}), slice(v, p + 2, size(v)))"
    put = f"case when p > 1 then {inner} else concat(array({merged}), slice(v, 3, size(v))) end"
    step = f"transform(array(array_min(v)), m -> case when m >= {none} * 65536 then v else transform(array(cast(array_position(v, m) as int)), p -> transform(array(m div 65536), b -> {put})[0])[0] end)[0]"
    return f"transform(aggregate(sequence(1, size({word})), {first}, (v, j) -> {step}), e -> cast(e % 65536 as int))"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the token ids of the whole text: `ids`, packed unsigned 32-bit little-endian, and `id_list`, an array."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("ids", "id_list")
    fields = [T.StructField(f"_bpe_{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)]
    at = docs.columns.index(text)
    keep = [i for i in range(len(fields)) if keep_text or i != at]
    names = [f"_bpe_{i}" for i in keep]
    total = docs.agg(F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_CHARS))
    long, binary = T.LongType(), T.BinaryType()
    schema = T.StructType([*[fields[i] for i in keep], T.StructField("_bpe_block", long), T.StructField("_bpe_bucket", T.IntegerType()), T.StructField("_bpe_words", T.ArrayType(binary)), T.StructField("_bpe_seq", binary)])
    cut = docs.mapInArrow(_cut(pattern, at, keep, buckets, schema), schema)
    # the blocks' texts lie in buckets by block, so that they need no exchange when their words come back
    cut = materialize(cut, "bpe", bucketed=("_bpe_block", max(1, -(-total // BLOCK_CHARS))), compression="zstd")
    # so many partitions as asked for, however small the exchange is: the fold is what takes the time
    words = cut.filter("_bpe_bucket is not null").select("_bpe_block", "_bpe_bucket", "_bpe_words").repartition(2 * buckets, "_bpe_bucket")
    distinct = words.groupBy("_bpe_bucket").applyInArrow(_distinct, "_bpe_bucket int, _bpe_part int, _bpe_letters array<array<int>>")
    ints = lambda x: pa.array([x], pa.list_(pa.int32()))
    constants = {"slots": pa.array([pair_table(ranks).tolist()], pa.list_(pa.int64())), "letters": ints([ranks[bytes([i])] for i in range(256)]), "pairs": ints([ranks.get(bytes([i >> 8, i & 255])) for i in range(65536)])}
    view = spark.createDataFrame(pa.table(constants))
    folded = distinct.withColumns({f"_{k}": view.select(k).scalar() for k in constants})
    ids = f"transform(_bpe_letters, w -> {fold('w', '_slots', '_letters', '_pairs')})"
    flat = f"transform(array({ids}), m -> named_struct('flat', flatten(m), 'sizes', transform(m, x -> cast(size(x) as tinyint))))[0]"
    folded = folded.select("_bpe_bucket", "_bpe_part", F.expr(flat).alias("_bpe_ids"))
    spread = words.groupBy("_bpe_bucket").cogroup(folded.groupBy("_bpe_bucket")).applyInArrow(_spread(ranks), "_bpe_block long, _bpe_bucket int, _bpe_sizes binary, _bpe_flat binary")
    out = T.StructType([*[fields[i] for i in keep], T.StructField("ids", binary), T.StructField("id_list", T.ArrayType(T.IntegerType()))])
    texts = cut.filter("_bpe_bucket is null").select(*names, "_bpe_block", "_bpe_words", "_bpe_seq")
    encoded = texts.groupBy("_bpe_block").cogroup(spread.groupBy("_bpe_block")).applyInArrow(_assemble(names), out)
    return encoded.withColumnsRenamed({f"_bpe_{i}": docs.columns[i] for i in keep})


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "id_list") -> DataFrame:
    """encoded with `decoded`: the binary pieces of its array of ids, concatenated; null ids give null, ids without a piece nothing.

    The pieces are a constant of the plan, as hexadecimal strings, because Spark joins arrays of strings but not of binaries.
    """
    pieces = [""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        pieces[rank] = word.hex()
    table = encoded.sparkSession.createDataFrame(pa.table({"pieces": pa.array([pieces], pa.list_(pa.string()))}))
    rows = encoded.drop("decoded").withColumn("_pieces", table.select("pieces").scalar())
    return rows.withColumn("decoded", F.expr(f"unhex(array_join(transform({ids}, i -> get(_pieces, i)), ''))")).drop("_pieces")
