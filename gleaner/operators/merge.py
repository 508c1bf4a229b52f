"""Cross-source merging, quotas, versions, run lengths and state deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order, by a partial aggregate on one struct (no sort of whole groups)."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return one.select(*keys, "_r.*")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return one.select(*keys, "_r.*")


def group_quota(df: DataFrame, group: str, score: str, tie: str, per_group: int, total: int) -> DataFrame:
    """The first rows of each group by score, then the first of all."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group).orderBy(F.desc_nulls_last(score), tie).limit(total)


def capped_with_backfill(df: DataFrame, host: str, position: str, cap: int, n: int) -> DataFrame:
    """n rows in position order, at most ``cap`` a host; rows beyond the cap fill what is left."""
    w = Window.partitionBy(host).orderBy(position)  # no host gives more than n rows, so its rank is limited before the shuffle
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).withColumn("deferred", (F.col("rn") > cap).cast("int")).orderBy("deferred", position).limit(n)


def round_robin(df: DataFrame, host: str, position: str, n: int) -> DataFrame:
    """One row of each host in turn, hosts by their first position."""
    a = df.withColumn("rn", F.row_number().over(Window.partitionBy(host).orderBy(position))).where(F.col("rn") <= n)  # limited before the shuffle
    a = a.withColumn("first_at", F.min(position).over(Window.partitionBy(host)))
    return a.orderBy("rn", "first_at", position).limit(n)


def run_lengths(df: DataFrame, key: str, order: list, label: str) -> DataFrame:
    """(key, run, label, n): consecutive equal labels of a key collapsed (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    a = df.withColumn("_new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return a.groupBy(key, "run").agg(F.first(label).alias(label), F.count("*").alias("n"))


def state_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new) where the value changed, appeared or went."""
    b, a = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    return b.join(a, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def richest(df: DataFrame, key: str, body: str, order: list, fill: list[str], sources: str) -> DataFrame:
    """One row per key: the longest body, each other field's first value in order, the ordered set of sources."""
    o = F.struct(*order)
    aggs = [F.max_by(body, F.struct(F.length(body), o)).alias(body)]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull() & (F.trim(F.col(c)) != ""), o)).alias(c) for c in fill]
    return df.groupBy(key).agg(*aggs, F.array_sort(F.collect_set(sources)).alias("merged_sources"), F.count("*").alias("n"))


def numbered_within(df: DataFrame, group: str, order: list[str], name: str, buckets: int = 64) -> DataFrame:
    """``df`` with the 1-based place of each row in its group, for groups of any size.

    Groups are cut into ranges of the first order column (bounds from a quantile
    sketch, a fixed number), ranked range by range, and each range starts behind
    the counts of the ranges before it: no task sorts a hot group whole.
    """
    bounds = df.approxQuantile(order[0], [i / buckets for i in range(1, buckets)], 0.01)
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    a = df.withColumn("_b", F.size(F.filter(cuts, lambda c: F.col(order[0]) > c)))
    per = a.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    start = per.withColumn("_s", F.sum("_c").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(group, "_b", F.coalesce("_s", F.lit(0)).alias("_s"))
    r = a.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)))
    return r.join(start, [group, "_b"]).withColumn(name, F.col("_s") + F.col("_r")).drop("_b", "_s", "_r")
