"""Structured Streaming mirrors of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import fixed


def session_windows(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions by inactivity; closed ones are emitted once the watermark passes."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def live_metrics(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean of value by tumbling window and type."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("started"), "event_type", "n", "mean_value")


def sliding_metrics(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Counts and mean of value by type in windows that overlap: each event counts in width / slide of them."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("started"), "event_type", "n", "mean_value")


def once(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first event of each key; a repeat within `late` of it is passed over, and state older than that goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def turns_with_records(turns: DataFrame, records: DataFrame, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Turns (session_id, turn_no, ts, ...) with the records of their answers (session_id, turn_no, recorded, ...) that follow within an interval; both sides' state goes once neither can meet."""
    t, r = turns.withWatermark("ts", late), records.withWatermark("recorded", late).withColumnsRenamed({"session_id": "_s", "turn_no": "_t"})
    near = (F.col("session_id") == F.col("_s")) & (F.col("turn_no") == F.col("_t")) & (F.col("recorded") >= F.col("ts")) & (F.col("recorded") <= F.col("ts") + F.expr(f"interval {within}"))
    return t.join(r, near).drop("_s", "_t")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over the progress that the query still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


STATS = "stage string, n long, seen long, mean double, p50 double, p95 double, max double"


def nearest_rank(values: list[float], percent: int) -> float:
    """The value at clamp(round_half_even(percent / 100 * n + 0.5), 1, n) of sorted values."""
    return values[max(1, min(len(values), round(percent / 100 * len(values) + 0.5))) - 1]


class _Ring(StatefulProcessor):
    """The last `most` samples of a stage, in the order of `at`."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "ms double")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, n = [], 0
        for part in rows:  # no more than `most` samples of a batch are held
            n += len(part)
            parts = [pd.concat([*parts, part[["at", "ms"]]]).sort_values("at", kind="stable").tail(self.most)]
        kept = ([r[0] for r in self.samples.get()] + parts[0]["ms"].tolist())[-self.most :]
        seen = n + (self.seen.get()[0] if self.seen.exists() else 0)
        self.samples.put([(x,) for x in kept])
        self.seen.update((seen,))
        s = sorted(kept)
        yield pd.DataFrame([(key[0], len(s), seen, sum(s) / len(s), nearest_rank(s, 50), nearest_rank(s, 95), s[-1])], columns=[c.split()[0] for c in STATS.split(", ")])

    def close(self) -> None:
        pass


def stage_registry(turns: DataFrame, most: int = fixed.SAMPLES) -> DataFrame:
    """A live registry: after each micro-batch a row of STATS for every stage that it timed, over the stage's last `most` samples, with exact percentiles.

    turns: the stages' times in milliseconds with total_ms, and `at`, by which samples are ordered. Times that are null or 0 are no samples.
    Needs the RocksDB state store.
    """
    names = [*fixed.STAGES, "total_ms"]
    pairs = ", ".join(f"'{s.removesuffix('_ms')}', cast({s} as double)" for s in names)
    each = turns.selectExpr("at", f"stack({len(names)}, {pairs}) as (stage, ms)").filter("ms > 0")
    return each.groupBy("stage").transformWithStateInPandas(_Ring(most), STATS, "Update", "None")
