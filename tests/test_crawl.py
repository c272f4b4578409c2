"""A crawl in steps against a breadth-first walk, bounded, resumed, after a crash."""

import pytest
from pyspark.sql import functions as F

from tessellar.operators.crawl import Crawl

#: u0 links to u1 and u2, and so on; u9 fails, u4 links back.
WEB = {"u0": ["u1", "u2"], "u1": ["u3", "u4"], "u2": ["u4", "u5", "u9"], "u3": ["u6"], "u4": ["u0", "u7"], "u5": [], "u6": ["u8"], "u7": [], "u8": []}


def walk(depth):
    seen, level = {"u0": 0}, ["u0"]
    for d in range(1, depth + 1):
        level = sorted({t for u in level for t in WEB.get(u, []) if t not in seen})
        seen |= dict.fromkeys(level, d)
    return {u: d for u, d in seen.items() if u in WEB}


def parts(spark):
    asked = []
    web = spark.createDataFrame([(u, ",".join(t)) for u, t in WEB.items()], "url string, html string")

    def fetch(rows):
        asked.extend(r.url for r in rows.collect())
        return rows.join(web, "url", "left").select("url", "html")

    links = lambda pages: pages.select(F.explode(F.split("html", ",")).alias("target")).filter("target <> ''")
    return asked, fetch, links, spark.createDataFrame([("u0",)], "url string")


def test_bounded_and_resumed(spark, tmp_path):
    asked, fetch, links, seeds = parts(spark)
    crawl = Crawl(spark, str(tmp_path))
    assert crawl.run(seeds, fetch, links, max_depth=3, max_pages=4) == 4
    assert asked == ["u0", "u1", "u2", "u3"]  # stops inside the third level
    assert crawl.run(seeds, fetch, links, max_depth=3, max_pages=100) == len(walk(3)) - 4
    assert len(asked) == len(set(asked)) == len(walk(3)) + 1  # u9 failed once, nothing was fetched twice
    assert {r.url: r.depth for r in crawl.pages.read().collect()} == walk(3)
    assert crawl.run(seeds, fetch, links) == 0 and len(asked) == len(set(asked))
    assert {r.url for r in crawl.frontier.read().filter("state = 'failed'").collect()} == {"u9"}


def test_held_urls_and_a_crash(spark, tmp_path):
    asked, fetch, links, seeds = parts(spark)
    crawl = Crawl(spark, str(tmp_path), step=2)
    held = spark.createDataFrame([("u1",), ("u0",)], "url string")

    def dies(rows):
        if "u2" in [r.url for r in rows.collect()]:
            raise RuntimeError("lost")
        return fetch(rows)

    with pytest.raises(RuntimeError):
        crawl.run(seeds, dies, links, max_depth=2, held=held)
    assert asked == ["u0"]
    assert crawl.run(seeds, fetch, links, max_depth=2, held=held) == 3
    assert asked == ["u0", "u2", "u4", "u5", "u9"] and "u1" not in {r.url for r in crawl.pages.read().collect()}
