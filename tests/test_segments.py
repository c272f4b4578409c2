"""The growing index against a fresh build, and what an addition costs."""

import random

from pyspark.sql import functions as F

from tessellar.operators import search, segments
from tessellar.operators.segments import Segments
from tessellar.sources.versioned import Table

WORDS = [f"word{i}" for i in range(60)]


def docs(spark, held):
    return spark.createDataFrame(sorted(held.items()), "chunk_id string, text string")


def of(rows):
    return {(r.query_id, r.chunk_id): round(r.score, 9) for r in rows.collect()}


def prose(rng):
    return " ".join(rng.choice(WORDS[: rng.randint(1, 60)]) for _ in range(rng.randint(0, 30)))


def test_scores_equal_a_fresh_build(spark, tmp_path):
    rng = random.Random(2)
    held, index = {}, Segments(spark, str(tmp_path / "grown"))
    asked = spark.createDataFrame([(1, "word1 word2 word59"), (2, "word0 word0 nothing"), (3, ""), (4, "word7")], "query_id long, text string")
    assert index.scores(asked).count() == 0
    sizes = []
    for step, n in enumerate([60, 3, 5, 1, 40, 2, 2]):
        batch = {f"d{rng.randrange(90):02d}": prose(rng) for _ in range(n)}
        gone = [k for k in sorted(held) if rng.random() < 0.1 and k not in batch] if step % 2 else []
        index.add(docs(spark, batch), spark.createDataFrame([(k,) for k in gone], "chunk_id string") if gone else None)
        held = {k: v for k, v in held.items() if k not in gone} | batch
        sizes.append(len(index.state()["segments"]))
        assert index.totals()[0] == len(held)
    fresh = search.Index.build(docs(spark, held), str(tmp_path / "fresh"), "chunk_id")
    want = of(fresh.scores(asked))
    assert want and of(index.scores(asked)) == want and abs(index.totals()[1] - fresh.totals.first().avgdl) < 1e-9
    assert max(sizes) <= 5 and index.living("lengths").count() == len(held)


def test_an_addition_costs_its_own_rows(spark, tmp_path):
    rng = random.Random(3)
    index = Segments(spark, str(tmp_path))
    index.add(docs(spark, {f"d{i}": prose(rng) for i in range(500)}))
    first = index.state()["segments"][0]
    index.add(docs(spark, {f"d{i}": prose(rng) for i in range(5)}))
    now = index.state()["segments"]
    assert now[0]["folder"] == first["folder"] and now[0]["n"] == 495 and now[1]["n"] == 5
    whole, part = (spark.read.parquet(f"{tmp_path}/{s['folder']}/postings").count() for s in now)
    assert part < 0.05 * whole
    # the same batch again and again leaves few segments
    for _ in range(5):
        index.add(docs(spark, {f"d{i}": "word1" for i in range(5)}))
    assert len(index.state()["segments"]) <= segments.FEW + 1 and index.totals()[0] == 500


def test_it_follows_a_table(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "session_id string, chunk_id string, text string", ("session_id", "chunk_id"))
    index = Segments(spark, str(tmp_path / "i"), scoped=True)
    scope = lambda rows: rows.withColumn("scope", F.col("session_id"))
    rows = lambda *r: spark.createDataFrame(list(r), "session_id string, chunk_id string, text string")
    asked = spark.createDataFrame([(1, "s1", "alpha"), (2, "s2", "alpha beta"), (3, None, "alpha")], "query_id long, scope string, text string")
    assert index.refresh(table, scope) == 0
    table.upsert(rows(("s1", "a", "alpha beta"), ("s1", "b", "beta"), ("s2", "c", "alpha"), ("s2", "d", "gamma delta")))
    assert index.refresh(table, scope) == 4 and set(of(index.scores(asked))) == {(1, "a"), (2, "c")}
    table.upsert(rows(("s1", "b", "alpha alpha"), ("s2", "e", "beta beta")))
    table.delete(F.col("chunk_id") == "a")
    assert index.refresh(table, scope) == 3 and index.refresh(table, scope) == 0
    got = of(index.scores(asked))
    assert set(got) == {(1, "b"), (2, "c"), (2, "e")}
    table.compact()
    table.upsert(rows(("s2", "c", "nothing")))
    assert index.refresh(table, scope) == 1 and set(of(index.scores(asked))) == {(1, "b"), (2, "e")}
    # a session's figures are its own: they equal an index of that session alone
    alone = search.Index.build(rows(("s2", "c", "nothing"), ("s2", "d", "gamma delta"), ("s2", "e", "beta beta")).select("chunk_id", "text"), str(tmp_path / "alone"), "chunk_id")
    want = of(alone.scores(asked.filter("query_id = 2").select("query_id", "text")))
    assert {k: v for k, v in of(index.scores(asked)).items() if k[0] == 2} == want
