"""Best-first crawl frontier over an offline page table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, per_round: int, rounds: int) -> DataFrame:
    """(url, depth): pages reached from the seeds; each round takes the ``per_round`` best open urls (priority, then url).

    pages: (url, priority); links: (src, dst). Visited urls leave by an anti-join; the bound per round is a parameter.
    """
    visited = None
    open_ = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    for _ in range(rounds):
        ready = open_ if visited is None else open_.join(visited.select("url"), "url", "left_anti")
        take = cut(ready.join(pages, "url").orderBy(F.desc("priority"), "url").limit(per_round).select("url", "depth"), "round")
        visited = take if visited is None else cut(visited.unionByName(take), "visited")
        found = take.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"))
        open_ = cut(ready.join(take.select("url"), "url", "left_anti").unionByName(found).groupBy("url").agg(F.min("depth").alias("depth")), "open")
        if take.limit(1).count() == 0:
            break
    return visited
