"""An inverted index that grows by immutable segments: adding a batch writes that batch, and scores equal those of a fresh build.

A segment holds the postings of its documents in the order of terms and their lengths. A batch's keys are also its tombstones: what older
segments hold of them does not count any more. The number of documents and their total length are sums kept in the commits
(sources.versioned.Log), so that they cost nothing to read; a document frequency is the number of living postings of a term, which a
search reads anyway. The newest segments are merged once together they hold as much as the one before them, so that there are about as many
segments as the size has binary digits, and a posting is written again about as often.

With a scope (a session's documents) every figure is that of the scope alone, and a question meets the documents of its own scope.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.versioned import Log
from . import search

#: Segments that are left alone, whatever their sizes.
FEW = 3


@dataclass(frozen=True)
class Segments:
    """key: the documents' key; `scoped`: documents have a column `scope`; stem: terms are stems."""

    spark: SparkSession
    path: str
    key: str = "chunk_id"
    scoped: bool = False
    stem: bool = True

    @property
    def _log(self) -> Log:
        return Log(self.spark, self.path)

    def state(self) -> dict[str, Any]:
        """The segments, oldest first ({folder, n, length, gone}), and the source's version that they follow."""
        return self._log.told()[1] or {"segments": [], "source": 0}

    # ---- writing ----------------------------------------------------------------------------------------------
    def _write(self, rows: DataFrame, lengths: DataFrame, gone: DataFrame | None) -> dict[str, Any]:
        """rows: (key, scope, term, tf, dl), lengths: (key, scope, dl), gone: keys that older segments lose."""
        folder = f"segments/{uuid.uuid4().hex}"
        # a frequent term is dealt over as many partitions as there are, so its postings are in no single file
        salt = F.pmod(F.xxhash64("key"), F.lit(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        rows.repartition("term", salt).sortWithinPartitions("term", "key").write.parquet(f"{self.path}/{folder}/postings")
        lengths.write.parquet(f"{self.path}/{folder}/lengths")
        lost = 0
        if gone is not None:
            gone.select("key").distinct().write.parquet(f"{self.path}/{folder}/gone")
            lost = self.spark.read.parquet(f"{self.path}/{folder}/gone").count()
        n, total = self.spark.read.parquet(f"{self.path}/{folder}/lengths").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"folder": folder, "n": n, "length": int(total), "gone": lost}

    def add(self, docs: DataFrame, gone: DataFrame | None = None, source: int = 0) -> int:
        """A batch (key, text[, scope]) replaces what is held of its keys; `gone` (key) goes without replacement. The number of segments afterwards.

        Costs the batch and a look at the older documents' lengths (a key and a number each).
        """
        scope = F.col("scope").cast("string") if self.scoped else F.lit(None).cast("string")
        named = docs.select(F.col(self.key).alias("key"), scope.alias("scope"), F.coalesce("text", F.lit("")).alias("text"))
        each = named.select("key", "scope", text.bound(text.tokens(F.col("text"), self.stem), lambda t: F.struct(F.size(t).alias("dl"), text.histogram(t).alias("h"))).alias("x"))
        rows = each.select("key", "scope", F.explode("x.h").alias("h"), F.col("x.dl").alias("dl")).select("key", "scope", F.col("h.item").alias("term"), F.col("h.n").cast("int").alias("tf"), "dl")
        lost = named.select("key")
        if gone is not None:
            lost = lost.union(gone.select(F.col(self.key).alias("key")))
        new = self._write(rows, each.select("key", "scope", F.col("x.dl").alias("dl")), lost)

        def plan(_: int, now: Any) -> tuple[Any, int]:
            held = (now or {"segments": []})["segments"]
            # tombstones matter only while something older is held
            segments = self._merged([*self._left(held, new), new if held else new | {"gone": 0}])
            return {"segments": segments, "source": source}, len(segments)

        return self._log.commit(plan)

    def _left(self, held: list[dict], new: dict) -> list[dict]:
        """Older segments with the figures of what lives on after a batch."""
        out = []
        for i, s in enumerate(held):
            dead = self._living(held, i).join(self._gone(new), "key", "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            out.append(s | {"n": s["n"] - dead[0], "length": s["length"] - int(dead[1])})
        return out

    def _gone(self, s: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{s['folder']}/gone")

    def _living(self, held: list[dict], i: int, what: str = "lengths") -> DataFrame:
        """Rows of a segment without the keys that a newer one has or loses."""
        rows = self.spark.read.parquet(f"{self.path}/{held[i]['folder']}/{what}")
        newer = [self._gone(s) for s in held[i + 1 :] if s["gone"]]
        if not newer:
            return rows
        dead = newer[0]
        for more in newer[1:]:
            dead = dead.union(more)
        return rows.join(dead, "key", "left_anti").select(*rows.columns)

    def _merged(self, held: list[dict]) -> list[dict]:
        """The newest segments as one, from the first that the ones after it outweigh."""
        if len(held) <= FEW:
            return held
        start = len(held) - 1
        weight = lambda s: s["n"] + s["gone"]
        while start > 0 and sum(map(weight, held[start:])) >= held[start - 1]["n"]:
            start -= 1
        if start == len(held) - 1:
            return held
        rows, lengths, gone = None, None, None
        for i in range(start, len(held)):
            p, q = self._living(held, i, "postings"), self._living(held, i)
            rows, lengths = (p, q) if rows is None else (rows.union(p), lengths.union(q))
            if start and held[i]["gone"]:
                gone = self._gone(held[i]) if gone is None else gone.union(self._gone(held[i]))
        return [*held[:start], self._write(rows, lengths, gone)]

    def refresh(self, table, of=lambda rows: rows) -> int:
        """Follow a versioned table (sources.versioned): index what changed since the version that is indexed. of: rows to (key, text[, scope]). How many keys were taken."""
        then, now = self.state()["source"], table.version().number
        if then == now:
            return 0
        if not then or then not in table.numbers():
            rows, gone = table.read(now), None
        else:
            changed = table.changes(then)
            rows, gone = changed.filter(~F.col("_gone")).drop("_gone"), changed.filter("_gone").select(self.key)
        n = rows.count() + (gone.count() if gone is not None else 0)
        if then and then not in table.numbers():  # the version indexed is not known any more: begin again
            self._log.commit(lambda _, __: ({"segments": [], "source": 0}, None))
        self.add(of(rows), gone, source=now)
        return n

    # ---- reading ----------------------------------------------------------------------------------------------
    def living(self, what: str = "postings") -> DataFrame:
        """All living postings (key, scope, term, tf, dl), or lengths (key, scope, dl)."""
        held, out = self.state()["segments"], None
        for i in range(len(held)):
            part = self._living(held, i, what)
            out = part if out is None else out.union(part)
        kinds = {"postings": "key string, scope string, term string, tf int, dl int", "lengths": "key string, scope string, dl int"}
        return self.spark.createDataFrame([], kinds[what]) if out is None else out

    def totals(self) -> tuple[int, float]:
        """Documents, and their mean length."""
        held = self.state()["segments"]
        n = sum(s["n"] for s in held)
        return n, sum(s["length"] for s in held) / n if n else 0.0

    def scores(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, key, score) of the documents that score above 0, for queries (query_id, text[, scope]); IDF as in search.Index."""
        by = ["scope"] if self.scoped else []
        asked = queries.select("query_id", *by, F.explode(F.array_distinct(text.tokens(F.col("text"), self.stem))).alias("term"))
        asked = search.few(asked)
        hits = self.living().join(asked.select("term", *by).distinct(), ["term", *by])
        df = hits.groupBy("term", *by).agg(F.count("*").alias("df"))
        if self.scoped:
            sizes = self.living("lengths").join(asked.select("scope").distinct(), "scope").groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("average"))
            weighed = asked.join(df, ["term", "scope"]).join(sizes, "scope")
        else:
            n, average = self.totals()
            weighed = asked.join(df, "term").withColumns({"n": F.lit(n), "average": F.lit(average)})
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = weighed.select("query_id", "term", *by, idf.alias("idf"), F.greatest("average", F.lit(1e-9)).alias("average"))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("average")))
        found = hits.join(weighed, ["term", *by]).groupBy("query_id", "key").agg(F.sum(part).alias("score"))
        return found.filter("score > 0").withColumnRenamed("key", self.key)
