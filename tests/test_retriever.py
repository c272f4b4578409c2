"""Vectors in cells, exact search in blocks, and the retriever over stored chunks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.operators import search, store, vectors
from tessellar.operators.retriever import Retriever

NOTICES = {"no_context": "nothing found", "model_down": "no model"}


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def clustered(n, groups, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + 0.7 * rng.normal(size=(n, dims))


def brute(x, asked, k):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return {(q, int(i)) for q in asked for i in sorted(range(len(u)), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:k]}


@pytest.mark.parametrize("n", [2000, 8000])
def test_recall_of_the_cells(spark, tmp_path, n):
    x = clustered(n, 60)
    rows = frame(spark, x)
    cells = vectors.Cells.build(rows, str(tmp_path))
    asked = rows.filter("vec_id % 200 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = brute(x, range(0, n, 200), 20)
    assert {(r.query_id, r.vec_id) for r in vectors.nearest(rows, asked, 20).collect()} == want
    got = {(r.query_id, r.vec_id) for r in cells.search(asked, 20, 0.15).collect()}
    assert cells.met(asked, 0.15) < 0.2 and len(got & want) / len(want) >= 0.9
    if n == 2000:
        again = vectors.Cells.open(spark, str(tmp_path))
        assert {(r.query_id, r.vec_id) for r in again.search(asked, 20, 1.0).collect()} == want
        # only the partitions that are met are read
        one = cells.search(asked.limit(1), 20, 0.05)
        assert "PartitionFilters: [cell" in one._jdf.queryExecution().executedPlan().toString()


def test_more_queries_than_one_block_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, size=(300, 3)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [0.0] * 3), (402, [math.nan, 1.0, 1.0]), (403, [1.0]), (404, [None, 1.0, 1.0]), (405, [math.inf, 0.0, 0.0])], "vec_id long, embedding array<float>")
    sound = [i for i in range(300) if x[i].any()]
    many = 3 * vectors.BLOCK + 5
    asked = spark.createDataFrame([(i, [float(v) for v in x[sound[i % len(sound)]]]) for i in range(many)], "query_id long, q array<double>")
    got = vectors.nearest(rows, asked, 3).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("l")).collect()
    assert len(got) == many
    u = {i: x[i] / np.linalg.norm(x[i]) for i in sound}
    for r in got[:: many // 20]:
        q = u[sound[r.query_id % len(sound)]]
        assert [v.vec_id for v in r.l] == sorted(sound, key=lambda i: (-round(float(q @ u[i]), 9), i))[:3]
    assert vectors.nearest(rows, asked.limit(0), 3).count() == 0 and vectors.nearest(rows.limit(0), asked.limit(2), 3).count() == 0


def test_a_scope_meets_its_own_alone(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0], f"s{i % 3}" if i % 4 else None) for i in range(40)], "vec_id long, embedding array<float>, session_id string")
    asked = spark.createDataFrame([(1, [1.0, 1.0], "s1"), (2, [1.0, 0.0], "s2"), (3, [1.0, 0.0], None), (4, [1.0, 0.0], "none")], "query_id long, q array<double>, session_id string")
    mine = {s: {i for i in range(40) if i % 4 and i % 3 == s} for s in (1, 2)}
    cells = vectors.Cells.build(rows, str(tmp_path), scope="session_id", cells=3)
    for found in (vectors.nearest(rows, asked, 50, scope="session_id"), cells.search(asked, 50, 1.0, scope="session_id")):
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert got == mine
    with pytest.raises(ValueError):
        vectors.Cells.build(rows, str(tmp_path / "b"), cells=2).search(asked, 1, scope="session_id")
    assert vectors.Cells.build(rows.limit(0), str(tmp_path / "c")).search(asked, 3).count() == 0


def chunk(i, text, kind=store.SHARED, session=None, url=""):
    return (i, text, f"title {i}", url, "en", kind, session, "f.txt" if session else None, 1 if session else None, None)


def test_the_retriever_over_stored_chunks(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), store.CHUNK)
    chunks = store.Chunks(spark, str(tmp_path / "store"), search.stub_embedding)
    found = Retriever(chunks, str(tmp_path / "index"), search.stub_embedding)
    ask = spark.createDataFrame([(1, "roaming price abroad", "s1"), (2, "roaming price abroad", "s2"), (3, "secret number", None), (4, "zebra", "")], "query_id long, question string, session_id string")
    assert found.search(ask).count() == 0
    refused = {r.query_id: r for r in found.answer(ask, None, NOTICES).collect()}
    assert all(r.resolution == "refused" and r.text == "nothing found" for r in refused.values())

    chunks.add_shared(rows(*[chunk(f"k{i}", f"page {i} tells of plans and bundles", url=f"u{i % 3}") for i in range(12)], chunk("roam", "the roaming price abroad is ten pounds", url="u9")))
    chunks.add_own(rows(chunk("a", "my bill has a secret number 77", store.OWN, "s1"), chunk("b", "roaming was charged", store.OWN, "s1")), "s1")
    chunks.add_own(rows(chunk("a", "another file of another customer, secret number", store.OWN, "s2")), "s2")
    found.refresh()
    hits = found.search(ask, share=1.0).collect()
    own = {(r.query_id, r.session_id) for r in hits if r.session_id}
    assert own == {(1, "s1"), (2, "s2")}  # never another's, and none without a session
    assert {r.chunk_id for r in hits if r.query_id == 1 and r.session_id} == {"a", "b"}
    assert [r.text for r in hits if r.query_id == 2 and r.session_id] == ["another file of another customer, secret number"]
    best = found.context(ask.filter("query_id = 3"), share=1.0).collect()
    assert len(best) == 6 and all(sum(b.url == r.url for b in best) <= 2 for r in best)
    told = {r.query_id: r for r in found.answer(ask, lambda prompt: F.when(prompt.isNotNull(), F.lit("It is ten pounds [1].")), NOTICES, share=1.0, scorer=search.overlap_score).collect()}
    assert told[1].resolution == "answered" and told[1].citations[0].title == "title roam" and told[4].resolution == "refused"

    # changes are found before the cells are made anew, and what is gone is not
    made = found._made.told()
    chunks.add_shared(rows(chunk("new", "zebra crossing", url="u5"), chunk("roam", "nothing of that kind", url="u9")))
    found.refresh()
    assert found._made.told() == made
    got = {(r.query_id, r.chunk_id): r for r in found.search(ask, share=1.0).collect()}
    assert got[4, "new"].bm25_rank == 0 and got[4, "new"].dense_score is not None and got[1, "roam"].text == "nothing of that kind"
    assert chunks.delete_session("s1") == 2
    found.refresh()
    assert not [r for r in found.search(ask, share=1.0).collect() if r.session_id == "s1"]
    chunks.add_shared(rows(*[chunk(f"z{i}", f"more {i}") for i in range(20)]))
    found.refresh()
    assert found._made.told()[0] == made[0] + 1 and found.search(ask.filter("query_id = 4"), share=1.0).count() == 34
