"""Training rows for the classifiers: a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 40


def some(frame: DataFrame, total: int, rows: int) -> DataFrame:
    """About `rows` of the `total` rows of a frame with doc_id: those whose id hashes below a bound; the same on every run, and all if there are no more."""
    bound = _RANGE if total <= rows else int(_RANGE * rows / total)
    return frame.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(_RANGE)) < bound)


def texts(frame: DataFrame, rows: int) -> list[bytes]:
    """The texts of a sample in the order of their ids; twice `rows` at most, however often an id is repeated."""
    found = frame.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).limit(2 * rows).collect()
    return [bytes(r.text) for r in sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id if r.doc_id is not None else 0, bytes(r.text)))]


def of_class(docs: DataFrame, labels: DataFrame, label: str, value: int, rows: int) -> list[bytes]:
    """Texts of about `rows` documents with a label; only their ids are broadcast."""
    ids = labels.filter(labels[label] == value).select("doc_id").distinct()
    chosen = some(ids, ids.count(), rows).limit(2 * rows)
    return texts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), rows)
