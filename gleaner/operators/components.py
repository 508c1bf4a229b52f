"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut, drop


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node connected with it; nodes are those of the edges.

    Every round is two aggregations and two joins on plain columns; the edge
    list is written to the shared folder each round and shrinks towards one
    star per component. Null ends are dropped, self-edges name a node alone.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    alone = e.where("u = v").select("v")
    e = cut(e.where("u <> v"), "edges")
    before = None
    while True:
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = e.select("v", "u").unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: every smaller neighbour is tied to the smallest
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        nxt = cut(small, "edges")
        r = nxt.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        drop(e)
        e, now = nxt, (r[0], r[1])
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
    lone = alone.distinct().select(F.col("v").alias("node"), F.col("v").alias("component")).join(out.select("node"), "node", "left_anti")
    return out.unionByName(lone)
