"""Encoding whole texts with a public vocabulary, and attributing tokens to sections of a text.

Long texts are encoded piece by piece, cut before a space that precedes a non-space, where the vocabulary's pattern always
cuts, so that the memory a text takes while it is encoded is bounded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import read_ranks
from .common import small_batches

#: Characters that are encoded at once, as far as the text has a place to cut it.
PIECE = 1 << 20
_CUT = re.compile(r"(?= \S)")


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class UnitEncoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False) of the tokenizers library.

    ranks_path: the same vocabulary as ranks; texts are then merged by tiktoken, with equal ids in a third of the
    time. Texts that hold the string of a special token always take the tokenizers library's whole-text path.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        ranks = read_ranks(ranks_path)
        self.whole = lambda: Tokenizer.from_file(tokenizer_path)  # rarely needed, and large
        self.tokenizer = None
        special = {t["id"]: t["content"] for t in json.loads(Path(tokenizer_path).read_text(encoding="utf-8"))["added_tokens"]}
        self.special = list(special.values())
        self.units = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max([*ranks.values(), *special]) + 1, np.int64)
        for word, rank in ranks.items():
            self.bytes_of[rank] = len(word)
        for i, word in special.items():
            self.bytes_of[i] = len(word.encode())

    def one(self, text: str | None) -> bytes:
        """Packed little-endian unsigned 32-bit ids; null is an empty text."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            self.tokenizer = self.tokenizer or self.whole()
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([np.array(self.units.encode_ordinary(part), "<u4").tobytes() for part in pieces(text)])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token; a token inside a character has that character."""
        sizes = self.bytes_of[np.frombuffer(self.one(text), "<u4")]
        ends = np.cumsum(sizes)
        character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        return character[ends - sizes], character[ends - 1]


_ENCODERS: dict[tuple[str, str], UnitEncoder] = {}


def encoder(tokenizer_path: str, ranks_path: str, pattern: str) -> UnitEncoder:
    """One encoder per vocabulary and worker process."""
    key = (tokenizer_path, ranks_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(tokenizer_path, ranks_path, pattern)
    return _ENCODERS[key]


def line_bounds(text: str) -> list[tuple[str, int, int]]:
    """(name, start, end) of each line with its line feed; an empty text is one empty line."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        end = min(at + len(line) + 1, len(text))
        out.append((f"line{i}", at, end))
        at = end
    return out


def attribute(docs: DataFrame, vocabulary: tuple[str, str, str], bounds: Callable[[str], list[tuple[str, int, int]]] = line_bounds, rule: str = "first") -> DataFrame:
    """(doc_id, section_no, section, start, end, n_tokens, n_crossing): the tokens of each section of each text.

    A text is encoded once, as a whole. Its tokens' character spans are joined to the sections' [start, end) intervals, which
    must be in order and may leave gaps. A token that crosses a boundary belongs, by rule, to the section of its
    `first` or `last` character, and n_crossing counts those among a section's tokens. Tokens outside all sections make
    a row with section_no -1 and null section. Null texts count as empty; repeated rows are counted row by row; an empty
    table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    if rule not in ("first", "last"):
        raise ValueError("rule: first or last")
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("section_no", T.IntegerType()), T.StructField("section", T.StringType())]
        + [T.StructField(k, T.LongType()) for k in ("start", "end", "n_tokens", "n_crossing")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = encoder(*vocabulary).spans
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sections = bounds(text or "")
                starts, ends = (np.array([s[k] for s in sections], np.int64) for k in (1, 2))
                first, last = spans(text) if text else (np.zeros(0, np.int64),) * 2
                place = lambda x, starts=starts, ends=ends: np.where((k := np.searchsorted(starts, x, "right") - 1) >= 0, np.where(x < ends[k], k, -1), -1) if len(starts) else np.full(len(x), -1)
                a, b = place(first), place(last)
                own = a if rule == "first" else b
                n = np.bincount(own + 1, minlength=len(sections) + 1).tolist()
                crossing = np.bincount(own[a != b] + 1, minlength=len(sections) + 1).tolist()
                told = [(-1, None, None, None, n[0], crossing[0])] if n[0] else []
                told += [(i, *s, n[i + 1], crossing[i + 1]) for i, s in enumerate(sections)]
                for row in told:
                    for column, value in zip(rows, (doc_id, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f) for c, f in zip(rows, [batch.schema.field(0).type, pa.int32(), pa.string(), *[pa.int64()] * 4], strict=True)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
