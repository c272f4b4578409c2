"""A crawl that is bounded and can be resumed: what is queued, fetched and failed lies in a table, and so do the pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize
from ..sources.versioned import Table


@dataclass(frozen=True)
class Crawl:
    """Breadth first: level by level, by URL within a level.

    A step fetches queued URLs of the lowest level, no more than are still allowed, writes their pages, and then, in one commit, what became of
    them and the links found. A run that dies fetches that step's URLs again and no others; a second run goes on where the first stopped.
    """

    spark: SparkSession
    path: str
    step: int = 10_000

    @property
    def frontier(self) -> Table:
        return Table(self.spark, f"{self.path}/frontier", "url string, depth int, state string", ("url",))

    @property
    def pages(self) -> Table:
        return Table(self.spark, f"{self.path}/pages", "url string, html string, depth int", ("url",))

    def run(self, seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], links: Callable[[DataFrame], DataFrame], max_depth: int = 3, max_pages: int = 400, held: DataFrame | None = None) -> int:
        """Fetch at most max_pages more pages; how many came.

        fetch: (url, depth) to (url, html), html null where it fails; links: (url, html) to (target), as they should be visited. held: URLs that are
        not fetched, unless they are seeds. Failures do not count as pages and are not tried again.
        """
        frontier = self.frontier
        frontier.insert_absent(seeds.select("url", F.lit(0).alias("depth"), F.lit("queued").alias("state")), ["url"])
        if held is not None:
            frontier.insert_absent(held.select("url", F.lit(0).alias("depth"), F.lit("held").alias("state")), ["url"])
        came = 0
        while came < max_pages:
            queued = frontier.read().filter("state = 'queued'")
            level = queued.agg(F.min("depth")).first()[0]
            if level is None:
                break
            batch = materialize(queued.filter(F.col("depth") == level).orderBy("url").limit(min(self.step, max_pages - came)), "batch")
            got = materialize(fetch(batch.select("url", "depth")).select("url", "html").join(batch.select("url"), "url", "left_semi").filter("html is not null").dropDuplicates(["url"]), "fetched")
            n = self.pages.upsert(got.withColumn("depth", F.lit(level)))
            told = batch.join(got.select("url", F.lit(True).alias("ok")), "url", "left").select("url", "depth", F.when(F.col("ok"), "fetched").otherwise("failed").alias("state"))
            if level < max_depth:
                found = links(got).select(F.col("target").alias("url")).filter("url is not null").distinct()
                new = found.join(frontier.read().select("url"), "url", "left_anti")
                told = told.union(new.select("url", F.lit(level + 1).alias("depth"), F.lit("queued").alias("state")))
            frontier.upsert(told)
            came += n
        return came
