"""Retrieval: postings, BM25, exact cosine, rank fusion, caps per source, confidence and refusal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources.shared import freed


def postings(docs: DataFrame, key: str = "doc_id", stem: bool = True) -> DataFrame:
    """(key, term, tf, dl): term frequencies and lengths. A document's terms are counted inside its row, so nothing is shuffled."""
    each = docs.select(key, text.bound(text.tokens(F.col("text"), stem), lambda t: F.struct(F.size(t).alias("dl"), text.histogram(t).alias("h"))).alias("x"))
    return each.select(key, F.col("x.dl").alias("dl"), F.explode("x.h").alias("h")).select(key, F.col("h.item").alias("term"), F.col("h.n").alias("tf"), "dl")


def term_counts(docs: DataFrame, stem: bool = True) -> DataFrame:
    """(term, occurrences, df) of a corpus, by partial sums before one exchange."""
    return postings(docs, docs.columns[0], stem).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("df"))


#: Rows of query terms up to which they are broadcast to the postings; beyond, the join shuffles.
BROADCAST_TERMS = 1_000_000
#: Partitions that a frequent term's postings are dealt to.
SPREAD = 32


@dataclass(frozen=True)
class Index:
    """An inverted index in files: postings in the order of terms in each file, document frequencies, and one row of totals."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    key: str
    #: The folder that it lies in, if it was opened there.
    path: str | None = None

    @staticmethod
    def build(docs: DataFrame, path: str, key: str = "doc_id", stem: bool = True) -> Index:
        """Tokenise the corpus once and write it. Postings are sorted by term, so that a query's terms prune row groups."""
        spark = docs.sparkSession
        found = postings(docs, key, stem)
        # a term's postings are spread over SPREAD partitions, whatever their number; a range partitioning would read the corpus twice
        salt = F.pmod(F.xxhash64(key), F.lit(SPREAD))
        with freed(spark):
            found.repartition("term", salt).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings")
        with freed(spark):
            written.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        # documents without a term have no posting, but count
        length = docs.select(F.size(text.tokens(F.col("text"))).alias("dl"))
        with freed(spark):
            length.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        return Index.open(spark, path, key)

    @staticmethod
    def open(spark: SparkSession, path: str, key: str = "doc_id") -> Index:
        """The index that lies in a folder; nothing is read from the corpus again."""
        return Index(*(spark.read.parquet(f"{path}/{k}") for k in ("postings", "terms", "totals")), key, path)

    def scores(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75, classic: bool = False, stem: bool = True) -> DataFrame:
        """(query_id, key, score) of the documents that score above 0, for queries (query_id, text).

        By default the IDF is ln(1 + (N - df + 0.5) / (df + 0.5)) and a query's distinct terms count. Classic: ln((N - df + 0.5) /
        (df + 0.5)), a quarter of the corpus's mean IDF in place of a negative one, and a term counts as often as the query has it.
        """
        asked = queries.select("query_id", F.explode(text.histogram(text.tokens(F.col("text"), stem))).alias("h")).select("query_id", F.col("h.item").alias("term"), (F.col("h.n") if classic else F.lit(1)).alias("times"))
        n, average = self.totals.select("n").scalar(), F.greatest(self.totals.select("avgdl").scalar(), F.lit(1e-9))
        raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        if classic:
            floor = self.terms.agg((F.avg(raw) * 0.25).alias("floor")).scalar()
            idf = F.when(raw < 0, floor).otherwise(raw)
        else:
            idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = self.terms.join(few(asked), "term").select("query_id", "term", (idf * F.col("times")).alias("idf"))
        # the postings' side is not cut by hot terms: with a broadcast of the queries it is never shuffled by term
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
        return self.postings.join(few(weighed), "term").groupBy("query_id", self.key).agg(F.sum(part).alias("score")).filter("score > 0")


def few(rows: DataFrame) -> DataFrame:
    """A broadcast hint behind a count: for the terms of queries."""
    return F.broadcast(rows) if rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else rows


def best(scored: DataFrame, k: int, key: str = "doc_id", by: str = "query_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank from 1, ties to the smaller key; the planner limits each task's groups before the exchange."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)).cast("int")
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def bm25_scores(query: Column, documents: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """BM25 of an array of token arrays (the few chunks of one session) against distinct query tokens, in one expression; 0 without a match."""
    sizes = F.transform(documents, F.size)
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    n = F.size(documents)
    average = F.greatest(F.when(n > 0, total / n).otherwise(0.0), F.lit(1e-9))
    df = lambda t: F.size(F.filter(documents, lambda d: F.array_contains(d, t)))
    weighed = F.transform(F.array_distinct(query), lambda t: text.bound(df(t), lambda c: F.struct(t.alias("t"), F.log(1 + (n - c + 0.5) / (c + 0.5)).alias("idf"))))

    def one(terms: Column) -> Column:
        tf = lambda d, t: F.size(F.filter(d, lambda x: x == t))
        part = lambda d, t: text.bound(tf(d, t["t"]), lambda f: t["idf"] * f * (k1 + 1) / (f + k1 * (1 - b + b * F.size(d) / average)))
        return F.transform(documents, lambda d: F.aggregate(terms, F.lit(0.0), lambda a, t: a + part(d, t)))

    return text.bound(weighed, one)


def top(scored: DataFrame, k: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """(key, score, rank): the k best, ties to the smaller key. One ordered limit, then ranks of k rows."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("int"))


def scoped(rows: DataFrame, session_id: str) -> DataFrame:
    """Rows of one session; a blank session is an error, never everything."""
    if not session_id:
        raise ValueError("a session id is required")
    return rows.filter(F.col("session_id") == session_id)


def fuse(ranked: list[tuple[DataFrame, float]], key: str = "doc_id", by: list[str] | None = None) -> DataFrame:
    """(by..., key, score, first_list, first_rank): reciprocal rank fusion of lists with a 1-based rank."""
    by = by or []
    out = None
    for i, (frame, weight) in enumerate(ranked):
        part = frame.select(*by, key, (F.lit(weight) / (F.lit(fixed.RRF) + F.col("rank"))).alias("w"), F.struct(F.lit(i).alias("l"), F.col("rank").alias("r")).alias("at"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*by, key).agg(F.sum("w").alias("score"), F.min("at").alias("at")).select(*by, key, "score", F.col("at.l").alias("first_list"), F.col("at.r").alias("first_rank"))


def retrieve(dense: DataFrame, sparse: DataFrame, own_dense: DataFrame, own_sparse: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """(query_id, chunk_id, score, rank, dense_score, bm25_rank) from four ranked lists (query_id, chunk_id, rank, and score for the dense ones).

    A session's own lists weigh BOOST. The pool is the union of all lists: a chunk that only the lexical lists found has no dense
    score; one in both dense lists keeps the session's. `bm25_rank` counts from 0 in the shared lexical list. Ties: dense, sparse,
    own dense, own sparse, then rank.
    """
    keys = ["query_id", "chunk_id"]
    fused = fuse([(dense, 1.0), (sparse, 1.0), (own_dense, fixed.BOOST), (own_sparse, fixed.BOOST)], "chunk_id", ["query_id"])
    cosine = dense.select(*keys, F.lit(0).alias("o"), "score").unionByName(own_dense.select(*keys, F.lit(1).alias("o"), "score"))
    cosine = cosine.groupBy(*keys).agg(F.max_by("score", "o").alias("dense_score"))
    pool = fused.join(cosine, keys, "left").join(sparse.select(*keys, (F.col("rank") - 1).alias("bm25_rank")), keys, "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first_list", "first_rank")
    return pool.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).drop("first_list", "first_rank")


def diversify(ranked: DataFrame, source: str, most: int = fixed.PER_SOURCE, exempt: Column | None = None, by: str | None = None) -> DataFrame:
    """At most `most` rows per source (and `by`) in rank order; exempt rows stay but count."""
    rn = F.row_number().over(Window.partitionBy(*([by] if by else []), source).orderBy("rank"))
    keep = F.col("rn") <= most
    return ranked.withColumn("rn", rn).filter(keep if exempt is None else keep | exempt).drop("rn")


def overlap_score(question: Column, passage: Column) -> Column:
    """Stand-in for a cross-encoder: the share of a question's distinct tokens that a passage holds; 0 without tokens."""
    held = lambda q: F.size(F.array_intersect(q, text.tokens(passage))) / F.size(q)
    return text.bound(F.array_distinct(text.tokens(question)), lambda q: F.when(F.size(q) > 0, held(q)).otherwise(0.0))


def rerank(candidates: DataFrame, top_k: int, scorer: Callable[[Column, Column], Column] | None = overlap_score) -> DataFrame:
    """candidates (query_id, question, text, rank, ...) with `rerank_score`, the top_k of each query by it, ranked anew; ties keep the order found.

    Without a scorer, or where it gives null, the order found stays and the score is null.
    """
    scored = candidates.withColumn("rerank_score", F.lit(None).cast("double") if scorer is None else scorer(F.col("question"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), "rank")
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top_k)


def confidence(rerank: Column, dense: Column) -> Column:
    """Aggregate: best rerank score, else best cosine, else 0.5, clamped; callers give 0 to queries without rows."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.max(rerank), F.max(dense), F.lit(0.5))))


def stub_embedding(t: Column) -> Column:
    """Sixteen numbers from SHA-256, a stand-in for an embedder."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(F.sha2(t, 256), 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)
