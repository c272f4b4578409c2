"""One retriever over stored chunks: questions in, the passages that an answer may use out.

Four ranked lists are fused for every question: the shared chunks by cosine (cells) and by BM25 (segments), and those of the question's own session by
both. What the indexes hold follows the tables by their changes: vectors that changed since the cells were made are compared one by one, and a new
set of cells is made once they are more than RENEW of all. A question without a session meets shared chunks alone; one session's chunks never meet another's question.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.shared import materialize
from ..sources.versioned import Log
from . import answers, search, store, vectors
from .segments import Segments

#: Share of the shared chunks that may change before the cells are made anew.
RENEW = 0.2
HIT = ["chunk_id", "text", "title", "url", "language", "source_kind", "session_id", "doc_name", "page", "section"]


@dataclass(frozen=True)
class Retriever:
    """embed: text to the vector of a query; questions may bring their vector as `q` instead."""

    chunks: store.Chunks
    path: str
    embed: Callable[[Column], Column] | None = None

    @property
    def _spark(self):
        return self.chunks.shared.spark

    @property
    def _made(self) -> Log:
        """Which cells are in use, and the table's version that they hold."""
        return Log(self._spark, f"{self.path}/cells-log")

    @property
    def shared_terms(self) -> Segments:
        return Segments(self._spark, f"{self.path}/terms-shared")

    @property
    def own_terms(self) -> Segments:
        return Segments(self._spark, f"{self.path}/terms-own", scoped=True)

    def refresh(self) -> None:
        """Bring the indexes up to the tables: their changes are added, and cells are made anew where too much has changed."""
        self.shared_terms.refresh(self.chunks.shared)
        self.own_terms.refresh(self.chunks.own, lambda rows: rows.withColumn("scope", F.col("session_id")))
        now = self.chunks.shared.version().number
        made = self._made.told()[1]
        if now and (made is None or (made["source"] != now and (made["source"] not in self.chunks.shared.numbers() or self._changed(made).count() > RENEW * self.chunks.shared_size()))):
            folder = f"cells/{now}" if made else "cells"
            vectors.Cells.build(self.chunks.shared.read(now).select("chunk_id", "embedding"), f"{self.path}/{folder}", "chunk_id")
            self._made.commit(lambda *_: ({"folder": folder, "source": now}, None))

    def _changed(self, made: dict) -> DataFrame:
        return self.chunks.shared.changes(made["source"])

    def _dense(self, asked: DataFrame, k: int, share: float) -> DataFrame:
        """The nearest shared chunks: by cells, and exactly among what changed since they were made."""
        made = self._made.told()[1]
        if made is None:
            return self._spark.createDataFrame([], f"query_id {dict(asked.dtypes)['query_id']}, chunk_id string, score double, rank int")
        cells = vectors.Cells.open(self._spark, f"{self.path}/{made['folder']}")
        if made["source"] == self.chunks.shared.version().number:
            return cells.search(asked, k, share)
        changed = self._changed(made)
        held = cells.search(asked, k, share, without=changed.select("chunk_id"))
        new = vectors.nearest(changed.filter(~F.col("_gone")), asked, k, "chunk_id", "embedding")
        return search.best(held.union(new).drop("rank"), k, "chunk_id")

    def search(self, questions: DataFrame, k: int = fixed.TOP_K, share: float = 0.15) -> DataFrame:
        """(query_id, score, rank, dense_score, bm25_rank, chunk columns): the k best chunks for questions (query_id, question[, session_id, q]).

        share: of the shared chunks that a question's vector meets; 1.0 is exact.
        """
        named = questions.withColumn("session_id", F.col("session_id") if "session_id" in questions.columns else F.lit(None).cast("string"))
        if "q" not in named.columns:
            if self.embed is None:
                raise ValueError("questions bring no vector and there is no embedder")
            named = named.withColumn("q", self.embed(F.col("question")))
        named = named.select("query_id", "session_id", F.col("question").alias("text"), F.col("q").cast("array<double>").alias("q"))
        named = materialize(named, "questions")
        own_k = max(8, k // 3)
        rounded = lambda rows: rows.withColumn("score", F.round("score", 9))
        dense = self._dense(named.select("query_id", "q"), k, share)
        sparse = search.best(rounded(self.shared_terms.scores(named.select("query_id", "text"))), k, "chunk_id")
        mine = named.filter("trim(session_id) <> ''")
        own = self.chunks.own.read().join(search.few(mine.select("session_id").distinct()), "session_id")
        own_dense = vectors.nearest(own, mine.select("query_id", "q", "session_id"), own_k, "chunk_id", "embedding", scope="session_id")
        own_sparse = search.best(rounded(self.own_terms.scores(mine.select("query_id", "text", F.col("session_id").alias("scope")))), own_k, "chunk_id")
        fused = materialize(search.retrieve(dense, sparse, own_dense, own_sparse, k).join(named.select("query_id", F.col("session_id").alias("_session")), "query_id"), "fused")
        shared = self.chunks.shared.read().select(*HIT).join(search.few(fused), "chunk_id")
        # the same id may be held by several sessions: a question takes its own session's
        owned = own.select(*HIT).join(search.few(fused.withColumnRenamed("_session", "session_id")), ["chunk_id", "session_id"])
        columns = ["query_id", "score", "rank", "dense_score", "bm25_rank", *HIT]
        return shared.select(*columns).union(owned.select(*columns))

    def context(self, questions: DataFrame, k: int = fixed.TOP_K, share: float = 0.15, scorer=None, most: int = fixed.CONTEXT) -> DataFrame:
        """What an answer may use: at most two chunks of a page (a session's own count, but stay), reranked if there is a scorer, the first `most` of each question."""
        page = F.coalesce(F.nullif("url", F.lit("")), F.nullif("doc_name", F.lit("")), F.col("chunk_id"))
        kept = search.diversify(self.search(questions, k, share).withColumn("_page", page), "_page", exempt=F.col("source_kind") == store.OWN, by="query_id").drop("_page")
        asked = kept.join(search.few(questions.select("query_id", "question")), "query_id")
        return search.rerank(asked, most, scorer)

    def answer(self, questions: DataFrame, generate: Callable[[Column], Column] | None, notices: dict[str, str], share: float = 0.15, scorer=None) -> DataFrame:
        """Every question with `passages`, `confidence` and what answers.answer makes of them, citations included; a question that finds nothing is refused."""
        found = self.context(questions, share=share, scorer=scorer)
        passage = F.struct("rank", "title", "url", "doc_name", "page", "text")
        each = found.groupBy("query_id").agg(F.array_sort(F.collect_list(passage)).alias("p"), search.confidence(F.col("rerank_score"), F.col("dense_score")).alias("confidence"))
        told = each.select("query_id", "confidence", F.transform("p", lambda x: x.dropFields("rank")).alias("passages"))
        empty = F.expr("cast(array() as array<struct<title:string,url:string,doc_name:string,page:int,text:string>>)")
        rows = questions.drop("q").join(told, "query_id", "left").withColumns({"passages": F.coalesce("passages", empty), "confidence": F.coalesce("confidence", F.lit(0.0))})
        return answers.answer(rows, generate, notices)
