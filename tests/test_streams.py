"""Streams against their batch queries on replayed files: registry, sweeper, sliding windows, repeats, interval joins."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessellar.operators import insights, store
from tessellar.sources import files, uploads
from tessellar.streaming import events as live
from tessellar.streaming import state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replay(spark, frame, path, by="file"):
    """One file for each value of `by`, read one a micro-batch in that order."""
    for i in sorted(r[0] for r in frame.select(by).distinct().collect()):
        frame.filter(F.col(by) == i).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def finish(query, tmp_path, name, mode):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def test_registry_equals_the_batch_after_each_micro_batch(rocks, tmp_path):
    rng = random.Random(1)
    rows = [(f, i, *(round(rng.expovariate(0.01), 1) if rng.random() < 0.7 else rng.choice([None, 0.0]) for _ in range(7))) for f in range(3) for i in range(f * 30, f * 30 + 30)]
    stages = ["asr_ms", "guardrail_ms", "retrieval_ms", "rerank_ms", "generation_ms", "tts_ms", "total_ms"]
    frame = rocks.createDataFrame(rows, "file int, at long, " + ", ".join(f"{s} double" for s in stages))
    seen = []
    stream = live.stage_registry(replay(rocks, frame, tmp_path / "in"), most=40)
    stream.writeStream.outputMode("update").foreachBatch(lambda b, i: seen.append({r.stage: r for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    seen = [s for s in seen if s]
    assert len(seen) == 3
    for f, got in enumerate(seen):
        each = frame.filter(F.col("file") <= f).selectExpr("at", f"stack(7, {', '.join(repr(s[:-3]) + ', ' + s for s in stages)}) as (stage, ms)").filter("ms > 0")
        last = insights.sample_window(each, "stage", ["at"], 40)
        want = {r.stage: r for r in insights.percentile_table(last, ["stage"], "ms", [50, 95]).collect()}
        more = {r.stage: r for r in last.groupBy("stage").agg(F.avg("ms").alias("mean"), F.max("ms").alias("max")).collect()}
        count = dict(each.groupBy("stage").count().collect())
        assert set(got) == set(want)
        for s, r in got.items():
            assert (r.n, r.p50, r.p95, r.seen, r.max) == (want[s].n, want[s].p50, want[s].p95, count[s], more[s].max) and abs(r.mean - more[s].mean) < 1e-9


def test_sessions_end_while_no_event_comes(rocks, tmp_path):
    chunks, kept, seen = store.Chunks(rocks, str(tmp_path / "store")), uploads.kept_files(rocks, str(tmp_path / "files")), []
    ids = [f"s{i}" for i in range(10)]
    chunks.own.replace(rocks.createDataFrame([(f"c{s}", "x", "", "", "en", store.OWN, s, "f", 1, None, None) for s in [*ids, "other"]], store.STORED))
    kept.replace(rocks.createDataFrame([(s, "f", bytearray(b"x")) for s in [*ids, "other"]], "session_id string, doc_name string, content binary"))
    before = chunks.own.version().number

    def bad(_):
        raise RuntimeError("hook")

    turns = rocks.createDataFrame([(0, s) for s in [*ids, *ids[:3]]], "file int, session_id string")
    failures, states = [], []
    clean = state.clean_up(None, chunks, [bad, seen.append], kept)

    def run(batch, i):
        states.extend(batch.collect())
        failures.extend(clean(batch, i))

    q = state.swept_sessions(replay(rocks, turns, tmp_path / "in"), ttl_seconds=3).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    until = time.time() + 150
    while time.time() < until and len(seen) < 10 and q.exception() is None:
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None and sorted(seen) == ids
    assert {(r.session_id, r.turns) for r in states if r.event == "expired"} == {(s, 2 if s in ids[:3] else 1) for s in ids}
    assert chunks.own.read().count() == 1 and kept.read().count() == 1 and len(failures) == 10
    # all that end together cost one commit
    assert chunks.own.version().number - before <= 2


def test_sliding_windows_and_late_rows(spark, tmp_path):
    rows = [(0, "2024-01-01 00:10:00", "click", 1.0), (0, "2024-01-01 00:50:00", "click", 3.0), (0, "2024-01-01 01:05:00", "view", 5.0), (1, "2024-01-01 09:00:00", "buy", 5.0), (2, "2024-01-01 08:50:00", "buy", 7.0), (3, "2024-01-01 00:20:00", "click", 100.0), (4, "2024-01-01 20:00:00", "end", 0.0)]
    frame = spark.createDataFrame(rows, "file int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    q = finish(live.sliding_metrics(replay(spark, frame, tmp_path / "in")), tmp_path, "sliding", "append")
    got = {(r.started, r.event_type): (r.n, r.mean_value) for r in spark.table("sliding").collect()}
    batch = live.sliding_metrics(frame.filter("value < 100 and event_type <> 'end'")).collect()
    assert got == {(r.started, r.event_type): (r.n, r.mean_value) for r in batch} and len([k for k in got if k[1] == "buy"]) == 5
    assert live.late_rows(q) >= 1


def test_repeats_and_interval_joins(spark, tmp_path):
    rows = [(0, 1, "2024-01-01 00:00:00"), (0, 2, "2024-01-01 00:01:00"), (1, 1, "2024-01-01 00:05:00"), (1, 3, "2024-01-01 00:30:00"), (2, 2, "2024-01-01 00:31:00")]
    frame = spark.createDataFrame(rows, "file int, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    finish(live.once(replay(spark, frame, tmp_path / "a"), ["event_id"]), tmp_path, "firsts", "append")
    assert sorted(r.event_id for r in spark.table("firsts").collect()) == [1, 2, 3] == sorted(r.event_id for r in frame.dropDuplicates(["event_id"]).collect())
    turns = spark.createDataFrame([(0, "s1", 1, "2024-01-01 00:00:00"), (0, "s1", 2, "2024-01-01 00:02:00"), (1, "s2", 1, "2024-01-01 00:03:00")], "file int, session_id string, turn_no long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    records = spark.createDataFrame([(0, "s1", 2, "2024-01-01 00:02:30", "b"), (1, "s1", 1, "2024-01-01 00:04:59", "a"), (2, "s2", 1, "2024-01-01 00:20:00", "too late"), (2, "s1", 2, "2024-01-01 00:01:59", "too early")], "file int, session_id string, turn_no long, recorded string, resolution string").withColumn("recorded", F.col("recorded").cast("timestamp"))
    joined = live.turns_with_records(replay(spark, turns, tmp_path / "t").drop("file"), replay(spark, records, tmp_path / "r").drop("file"))
    finish(joined, tmp_path, "joined", "append")
    told = lambda rows: sorted((r.session_id, r.turn_no, r.resolution) for r in rows)
    want = told(live.turns_with_records(turns.drop("file"), records.drop("file")).collect())
    assert told(spark.table("joined").collect()) == want == [("s1", 1, "a"), ("s1", 2, "b")]


def test_files_of_uploads_are_kept_and_removed(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    body = "\n".join(f"Line {i} of the customer's bill with an amount of {i} pounds." for i in range(30))
    for name, content in {"bill.txt": body, "empty.md": "  ", "a.exe": "x"}.items():
        (folder / name).write_text(content)
    chunks, kept = store.Chunks(spark, str(tmp_path / "store")), uploads.kept_files(spark, str(tmp_path / "files"))
    kept.upsert(spark.createDataFrame([("s1", "empty.md", bytearray(b"before")), ("s2", "empty.md", bytearray(b"another's"))], "session_id string, doc_name string, content binary"))
    uploads.ingest(files.uploads(spark, str(folder)), "s1", chunks, kept=kept)
    assert {(r.session_id, r.doc_name) for r in kept.read().collect()} == {("s1", "bill.txt"), ("s2", "empty.md")}
    assert bytes(kept.read(first="s1").first().content).decode() == body
