"""Tables of chunks and records: scoped writes and reads, keys, append-only logs. See sources.versioned for how a table changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safety
from ..sources.shared import materialize
from ..sources.versioned import KeyRefused, Table
from . import curate

__all__ = ["KeyRefused", "Table"]

CHUNK = "chunk_id string, text string, title string, url string, language string, source_kind string, session_id string, doc_name string, page int, section string"
#: Chunks as they are stored.
STORED = CHUNK + ", embedding array<float>"
SHARED, OWN = "shared", "user_doc"
CUSTOMERS = "customer_id string, msisdn string, full_name string, plan string, balance double, bill_due_date string"
PERMISSIONS = "session_id string, customer_id string, scope string"
TICKETS = "ticket_id string, customer_id string, session_id string, subject string, body string, status string, created_at string"
AUDIT = "audit_id string, session_id string, intent string, allowed int, reason string, created_at string"
SCHEMAS = {"customers": CUSTOMERS, "permissions": PERMISSIONS, "tickets": TICKETS, "action_audit": AUDIT}
#: The columns that tell a table's rows apart; each key is unique by itself.
KEYS = {"chunks": [["chunk_id"]], "customers": [["customer_id"], ["msisdn"]], "permissions": [["session_id", "customer_id", "scope"]], "tickets": [["ticket_id"]], "action_audit": [["audit_id"]]}


class ScopeError(ValueError):
    """A session's rows were asked for without a session, or rows would land where they do not belong."""


def need_session(session_id: str | None) -> str:
    if not session_id or not session_id.strip():
        raise ScopeError("a session id is required")
    return session_id


def refuse(rows: DataFrame, bad: Column, why: str) -> None:
    """Raise if a row is bad; one short job that stops at the first such row."""
    if not rows.filter(F.coalesce(bad, F.lit(True))).limit(1).isEmpty():
        raise ScopeError(why)


def repeated(rows: DataFrame, keys: list[list[str]]) -> DataFrame:
    """(key, n): keys that occur more than once, for tests of uniqueness. None for a sound table."""
    out = None
    for key in keys:
        found = rows.groupBy(F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
        out = found if out is None else out.unionByName(found)
    return out


def flattened(chunks: DataFrame, distance: Column | None = None) -> DataFrame:
    """Chunks as hits: absent fields get their defaults; similarity is 1 - distance, and dense_rank counts from 0 in each query; without a distance a hit has neither."""
    filled = chunks.withColumns({c: F.coalesce(c, F.lit("")) for c in ("text", "title", "url")})
    known = F.col("language").isin("ar", "arz", "en", "mixed")
    filled = filled.withColumns({"language": F.when(known, F.col("language")).otherwise("unknown"), "source_kind": F.coalesce("source_kind", F.lit(SHARED))})
    if distance is None:
        return filled.withColumns({"score": F.lit(0.0), "dense_score": F.lit(None).cast("double"), "dense_rank": F.lit(None).cast("int")})
    from pyspark.sql import Window

    rank = (F.row_number().over(Window.partitionBy("query_id").orderBy(distance, "chunk_id")) - 1).cast("int")
    return filled.withColumns({"score": 1 - distance, "dense_score": 1 - distance, "dense_rank": F.when(distance.isNotNull(), rank)})


def named(spark: SparkSession, path: str, name: str) -> Table:
    """One of the tables of actions (customers, permissions, tickets, action_audit) with its keys enforced."""
    key, *unique = map(tuple, KEYS[name])
    return Table(spark, f"{path}/{name}", SCHEMAS[name], key, tuple(unique))


class Chunks:
    """Shared chunks and sessions' own chunks with their vectors, in two tables that no read or write mixes.

    embed: text to vector; without it, and where rows bring no `embedding`, vectors are null. A session's chunks lie in one bucket
    of files, so that its reads and deletes leave the other buckets alone.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] | None = None):
        self.shared, self.own = Table(spark, f"{path}/shared", STORED, ("chunk_id",)), Table(spark, f"{path}/own", STORED, ("session_id", "chunk_id"))
        self.embed = embed

    def _with_vectors(self, rows: DataFrame) -> DataFrame:
        if "embedding" not in rows.columns:
            rows = rows.withColumn("embedding", (F.lit(None) if self.embed is None else self.embed(F.col("text"))).cast("array<float>"))
        last = rows.dropDuplicates(["session_id", "chunk_id"])
        return last.select(*self.shared.columns)

    def add_shared(self, rows: DataFrame) -> int:
        refuse(rows, F.col("source_kind") != SHARED, "only shared chunks belong in the shared table")
        return self.shared.upsert(self._with_vectors(rows).dropDuplicates(["chunk_id"]))

    def add_own(self, rows: DataFrame, session_id: str) -> int:
        need_session(session_id)
        refuse(rows, F.col("session_id") != session_id, "a chunk belongs to another session than the one that writes it")
        refuse(rows, F.col("source_kind") != OWN, "a session holds uploaded documents only")
        return self.own.upsert(self._with_vectors(rows))

    def rows_of_session(self, session_id: str) -> DataFrame:
        """One session's stored rows, vectors included."""
        return self.own.read(first=need_session(session_id))

    def of_session(self, session_id: str) -> DataFrame:
        """One session's chunks as hits without a score."""
        return flattened(self.rows_of_session(session_id).drop("embedding"))

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """The shared chunks with the given chunk_id, as hits without a score."""
        return flattened(self.shared.read().drop("embedding").join(ids.select("chunk_id").distinct(), "chunk_id"))

    def shared_size(self) -> int:
        return self.shared.read().count()

    def session_size(self, session_id: str) -> int:
        return self.rows_of_session(session_id).count()

    def delete_session(self, session_id: str) -> int:
        """Remove one session's chunks; how many went. Writes their keys alone."""
        need_session(session_id)
        return self.own.delete(F.col("session_id") == session_id, first=session_id)

    def delete_sessions(self, ids: DataFrame) -> DataFrame:
        """Remove the chunks of many sessions (session_id) in one commit; (session_id, n) of those that had some."""
        gone = ids.select("session_id").filter("trim(session_id) <> ''").distinct()
        return self.own.delete_matching(gone)

    def reset_shared(self) -> None:
        self.shared.reset()


def stored_turns(turns: DataFrame) -> DataFrame:
    """Turn records as they may be kept: free text, entities and citations are masked, and an action's result gives way to its sorted field names."""
    out = turns.withColumns({c: safety.mask(F.col(c)) for c in ("question", "transcript") if c in turns.columns})
    if "entities" in turns.columns:
        out = out.withColumn("entities", F.transform_values("entities", lambda _, v: safety.mask(v)))
    if "citations" in turns.columns:
        hide = lambda c: c.withField("title", safety.mask(c["title"])).withField("snippet", safety.mask(c["snippet"])).withField("doc_name", safety.mask(c["doc_name"]))
        out = out.withColumn("citations", F.transform("citations", hide))
    if "action" in turns.columns:
        names = F.concat_ws(",", F.array_sort(F.map_keys("action.result")))
        hidden = F.create_map(F.lit("redacted"), F.lit("true"), F.lit("fields"), names)
        kept = F.when(F.coalesce(F.size("action.result"), F.lit(0)) > 0, hidden).otherwise(F.col("action.result"))
        out = out.withColumn("action", F.when(F.col("action").isNotNull(), F.col("action").withField("result", kept)))
    return out


def append_turns(turns: DataFrame, path: str) -> bool:
    """Append masked turn records as JSON lines. A failure to write is reported, never raised: what is measured must not break."""
    try:
        stored_turns(turns).write.mode("append").json(path)
    except Exception:  # any failure of the sink
        return False
    return True


def json_lines(rows: DataFrame) -> DataFrame:
    """(line): every row as JSON, letters of all scripts as they are."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def index_documents(pages: DataFrame, chunks: Chunks, embed, dim: int, reset: bool = False) -> DataFrame:
    """Documents to shared chunks with vectors; (chunk columns, embedding) as stored. Stops before any commit if there are no chunks or a vector has another length.

    Texts are embedded once, into a folder that the table then takes its rows from.
    """
    rows = curate.chunk_rows(pages, SHARED).withColumn("embedding", embed(F.col("text")).cast("array<float>"))
    made = materialize(rows, "embedded")
    if made.isEmpty():
        raise ValueError("the documents make no chunks")
    refuse(made, F.size("embedding") != dim, f"the embedder's vectors do not have {dim} components")
    if reset:
        chunks.reset_shared()
    chunks.add_shared(made)
    return made
