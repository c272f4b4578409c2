"""The same best documents as the whole index gives, from fewer blocks."""

import random
import time

from tessellar.operators import blockmax, search
from tessellar.sources.shared import materialize


def test_same_results_from_fewer_blocks(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    pick = lambda n: " ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(n))
    rows = [(i, pick(rng.choice([5, 20, 80]))) for i in range(1500)] + [(2000 + i, "w1 w2 w3") for i in range(40)] + [(3000, ""), (3001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = search.Index.build(docs, str(tmp_path / "index"))
    blocks = blockmax.Blocks.build(index, str(tmp_path / "blocks"))
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w0 w300 w150"), (3, "w399"), (4, "unknown"), (5, "w5 w5 w6 w7 w8 w9 w250"), (6, None)], "query_id long, text string")
    whole = index.scores(asked).selectExpr("query_id", "doc_id", "round(score, 9) as score")
    for k in (1, 10, 45):
        got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in blocks.search(asked, k).collect()}
        assert got == {(r.query_id, r.rank): (r.doc_id, r.score) for r in search.best(whole, k).collect()} and got
    read, held = blocks.read(asked, 5)
    assert 0 < read < 0.75 * held, (read, held)
    again = blockmax.Blocks.open(spark, str(tmp_path / "blocks"))
    assert again.n == len(rows) and again.search(asked.limit(0), 5).count() == 0
    empty = blockmax.Blocks.build(search.Index.build(docs.limit(0), str(tmp_path / "i0")), str(tmp_path / "b0"))
    assert empty.search(asked, 5).count() == 0


def folder_size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_bounds_take_less_than_the_index_and_no_shuffle(spark, tmp_path):
    """Before, the postings were written again with their blocks, after a shuffle of them all."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.choice([20, 60, 200])))) for i in range(2000)], "doc_id long, text string")
    index = search.Index.build(docs, str(tmp_path / "index"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bounds", "bounds of blocks")
    blocks = blockmax.Blocks.build(index, str(tmp_path / "blocks"))
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("bounds")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs and all(len(j.stageIds) == 1 for j in jobs)
    assert folder_size(tmp_path / "blocks") < folder_size(tmp_path / "index" / "postings")
    whole = index.postings.groupBy("term").count().count()
    assert blocks.tops.select("term").distinct().count() == whole


def test_the_shuffle_files_of_a_write_go_with_it(spark, tmp_path):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    data = lambda: {x for x in manager.getAllFiles().mkString(",").split(",") if x.endswith(".data")}
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} w{i}") for i in range(3000)], "doc_id long, text string")
    before = data()
    search.Index.build(docs, str(tmp_path / "index"))
    materialize(docs.repartition(3, "doc_id"), "t")
    for _ in range(40):  # they go in the background
        if not data() - before:
            break
        time.sleep(0.25)
    assert not data() - before
