"""Conversations as keyed state on Structured Streaming: streaks, one escalation a session, expiry with clean-up, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..operators import store
from ..sources.shared import materialize
from ..sources.versioned import Table

TURNS = "session_id string, turn_no long, ts timestamp, low_confidence boolean, repeated boolean, score double"
OUT = "session_id string, turn_no long, event string, low_before int, repeat_before int, low_streak int, repeat_streak int, escalate boolean, turns long"
_STATE = "low int, again int, handed boolean, turns long"


def session_states(turns: DataFrame, ttl_seconds: int = fixed.TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """A row for each turn with the streaks it found and left, whether it escalates (once a session), and a row `expired` when a session ends.

    Turns of one session in a micro-batch are taken in the order of turn_no. A session's state goes once the watermark is more than
    ttl_seconds past its last turn; a turn after that starts a new one.
    """

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            low, again, _, seen = state.get
            state.remove()
            yield pd.DataFrame([(key[0], None, "expired", None, None, low, again, False, seen)], columns=_COLUMNS)
            return
        low, again, handed, seen = state.get if state.exists else (0, 0, False, 0)
        rows, last = [], 0
        for t in pd.concat(list(batches)).sort_values("turn_no").itertuples():
            escalate = bool(t.score >= fixed.HANDOFF) and not handed
            before, handed, seen = (low, again), handed or escalate, seen + 1
            low, again = (low + 1) * bool(t.low_confidence), (again + 1) * bool(t.repeated)
            rows.append((key[0], t.turn_no, "turn", *before, low, again, escalate, seen))
            last = max(last, int(t.ts.timestamp() * 1000))
        state.update((low, again, handed, seen))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ttl_seconds * 1000 + 1)
        yield pd.DataFrame(rows, columns=_COLUMNS)

    marked = turns.withWatermark("ts", late)
    return marked.groupBy("session_id").applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def clean_up(states: DataFrame, chunks: store.Chunks, hooks: list[Callable[[str], None]] | None = None, uploads: Table | None = None) -> Callable[[DataFrame, int], list[str]]:
    """For foreachBatch: the chunks of all sessions that a batch ends go first, in one commit, then their uploaded files, in another, then the hooks run for each; what fails does not stop the others. Returns the failures."""

    def run(batch: DataFrame, _: int) -> list[str]:
        failed = []
        ended = materialize(batch.filter("event = 'expired'").select("session_id").distinct(), "ended")
        if ended.isEmpty():
            return failed
        for step in (chunks.delete_sessions, *([uploads.delete_matching] if uploads else [])):
            try:
                step(ended)
            except Exception as problem:  # a table that cannot be written must not keep the rest
                failed.append(f"all: {problem}")
        for row in ended.toLocalIterator() if hooks else []:  # only ids, streamed one partition at a time
            for hook in hooks:
                try:
                    hook(row.session_id)
                except Exception as problem:  # a hook is a caller's code
                    failed.append(f"{row.session_id}: {problem}")
        return failed

    return run


SWEPT = "session_id string, event string, turns long"


class _Timer(StatefulProcessor):
    """Ends a session when nothing has come for ttl_ms of wall-clock time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.turns = handle, handle.getValueState("turns", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(r) for r in rows) + (self.turns.get()[0] if self.turns.exists() else 0)
        self.turns.update((n,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield pd.DataFrame([(key[0], "turn", n)], columns=["session_id", "event", "turns"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.turns.get()[0] if self.turns.exists() else 0
        self.turns.clear()
        yield pd.DataFrame([(key[0], "expired", n)], columns=["session_id", "event", "turns"])

    def close(self) -> None:
        pass


def swept_sessions(turns: DataFrame, ttl_seconds: float = fixed.TTL_SECONDS) -> DataFrame:
    """A row `turn` for each session that a micro-batch touches and a row `expired` when a session has been idle for ttl_seconds, even if no event comes from anyone: for `clean_up`.

    Needs the RocksDB state store.
    """
    return turns.select("session_id").groupBy("session_id").transformWithStateInPandas(_Timer(int(ttl_seconds * 1000)), SWEPT, "Append", "ProcessingTime")


def adopt_sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions by inactivity with an id of their own, derived from the user and the first event, so that a late return starts a new one."""
    windows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    id_ = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.unix_micros("w.start").cast("string")), 256)
    return windows.select("user_id", F.substring(id_, 1, 32).alias("session_id"), F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n")


def trace(turns: DataFrame, path: str, checkpoint: str):
    """Append masked turn records as JSON lines."""
    return store.stored_turns(turns).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def emit(turns: DataFrame, path: str, registry: Callable[[DataFrame], None], checkpoint: str):
    """One record to the trace and to the measures, on every exit; a failing measure does not stop the trace."""

    def both(batch: DataFrame, _: int) -> None:
        store.append_turns(batch, path)
        try:
            registry(batch)
        except Exception:  # measures must not break what they measure
            return

    return turns.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
