"""BM25 by blocks with upper bounds: the same k best documents, without reading most postings.

Documents of like length are dealt to pages of about PAGE by a hash, and all terms' postings of a page are cut at its ends: a block is one term in one page, with the
maximum of its postings' weights. A posting tells its own page (by length and key), so the postings stay in the index and are not written again, and the maxima are
taken where the index's files are read: nothing is shuffled. What is read of one term and page in two parts has two maxima, whose sum bounds it as well. A page's bound for a question is the sum of its terms' maxima times their IDF; no document of
the page can score more. The first round scores every question's best pages by their bounds, with about FIRST * k documents, and its k-th best score there is a threshold; the second round
reads the pages whose bound reaches it and no others. Bounds are read from two numbers a block, without the postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import materialize
from . import search

PAGE = 4
#: Classes of length that documents commonly fall into.
CLASSES = 16
#: Documents in the pages that the first round scores, for each that is asked for.
FIRST = 8
#: What rounding may take from a bound.
SLACK = 1e-9


def _class(dl):
    """Documents of one page have lengths within a fifth of each other: a term's weights in a page are then close to its maximum."""
    return F.floor(F.log(1.2, F.greatest(dl, F.lit(1)).cast("double")))


def _first(k: int) -> int:
    return max(1, -(-FIRST * k // PAGE))


def _maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest weight of each term and page, of rows that lie in that order."""
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by(["term", "page"], use_threads=False).aggregate([("w", "max")])
        yield from found.select(["term", "page", "w_max"]).rename_columns(["term", "page", "top"]).to_batches()


@dataclass(frozen=True)
class Blocks:
    """tops: (term, page, top); the index holds the postings."""

    tops: DataFrame
    index: search.Index
    n: int
    average: float
    k1: float
    b: float
    stem: bool

    @property
    def key(self) -> str:
        return self.index.key

    @staticmethod
    def build(index: search.Index, path: str, k1: float = 1.5, b: float = 0.75, stem: bool = True) -> Blocks:
        """Bounds of an inverted index that lies in a folder, written once. A block has PAGE postings at most on average, so no group is large, however frequent a term."""
        if index.path is None:
            raise ValueError("the index has no folder")
        spark = index.postings.sparkSession
        n, average = index.totals.select("n", "avgdl").first()
        blocks = Blocks(index.postings, index, n, average, k1, b, stem)
        each = blocks._placed(index.postings).select("term", "page", "w").sortWithinPartitions("term", "page")
        each.mapInArrow(_maxima, "term string, page int, top double").write.mode("overwrite").parquet(f"{path}/tops")
        told = spark.createDataFrame([(index.path, index.key, n, average, k1, b, stem)], "source string, key string, n bigint, average double, k1 double, b double, stem boolean")
        told.coalesce(1).write.mode("overwrite").parquet(f"{path}/told")
        return Blocks.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Blocks:
        told = spark.read.parquet(f"{path}/told").first()
        return Blocks(spark.read.parquet(f"{path}/tops"), search.Index.open(spark, told.source, told.key), told.n, told.average, told.k1, told.b, told.stem)

    def _placed(self, postings: DataFrame) -> DataFrame:
        """(term, key, page, w) of postings."""
        pages = max(1, round(self.n / PAGE / CLASSES))
        page = (_class(F.col("dl")) * pages + F.pmod(F.xxhash64(self.key), F.lit(pages))).cast("int")
        weight = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / max(self.average, 1e-9)))
        return postings.select("term", self.key, page.alias("page"), weight.alias("w"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, idf) of the terms that the corpus holds."""
        each = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("text"), self.stem))).alias("term"))
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return self.index.terms.join(search.few(each), "term").select("query_id", "term", idf.alias("idf"))

    def _scored(self, asked: DataFrame, pages: DataFrame, k: int) -> DataFrame:
        """The k best documents of each question within the given (query_id, page)."""
        hits = self._placed(self.index.postings).join(search.few(asked), "term").join(search.few(pages), ["query_id", "page"], "left_semi")
        scored = hits.groupBy("query_id", self.key).agg(F.round(F.sum(F.col("idf") * F.col("w")), 9).alias("score"))
        return search.best(scored.filter("score > 0"), k, self.key)

    def plan(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """(asked terms, bounds of all pages, pages of the first round, what it found, pages of the second round)."""
        asked = materialize(self._asked(queries), "asked")
        bounds = self.tops.join(search.few(asked), "term").groupBy("query_id", "page").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.count("*").alias("blocks"))
        bounds = materialize(bounds, "bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "page")
        pages = materialize(bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= _first(k)).select("query_id", "page", "blocks"), "pages")
        first = materialize(self._scored(asked, pages.select("query_id", "page"), k), "first")
        threshold = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(search.few(threshold), "query_id", "left").filter(F.col("bound") + SLACK >= F.coalesce("least", F.lit(0.0)))
        rest = rest.join(search.few(pages.select("query_id", "page")), ["query_id", "page"], "left_anti")
        return asked, bounds, pages, first, rest.select("query_id", "page", "blocks")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, key, score, rank): the k best by BM25, as search.Index.scores and search.best give them; scores to nine places."""
        asked, _, _, first, rest = self.plan(queries, k)
        more = self._scored(asked, rest.select("query_id", "page"), k)
        return search.best(first.union(more).drop("rank"), k, self.key)

    def read(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """Blocks that a search reads with their postings, and those that hold a question's terms."""
        _, bounds, pages, _, rest = self.plan(queries, k)
        total, first, more = (x.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0] for x in (bounds, pages, rest))
        return first + more, total
