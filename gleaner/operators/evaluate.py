"""Retrieval metrics, agreement and threshold search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ir_metrics(runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, rr, ndcg) at k; runs: (query_id, doc, rank), qrels: (query_id, doc, grade > 0). A query without a run scores 0."""
    hit = qrels.join(runs, ["query_id", "doc"], "left")
    within = F.col("rank") <= k
    ideal = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc")
    g = hit.withColumn("best", F.row_number().over(ideal))
    gain = lambda grade, rank: (F.pow(F.lit(2.0), grade) - 1) / (F.log(rank + 1) / F.log(F.lit(2.0)))
    return g.groupBy("query_id").agg(
        (F.count(F.when(within, 1)) / F.count("*")).alias("recall"),
        (F.count(F.when(within, 1)) / F.lit(k)).alias("precision"),
        F.coalesce(1 / F.min(F.when(within, F.col("rank"))), F.lit(0.0)).alias("rr"),
        (F.coalesce(F.sum(F.when(within, gain(F.col("grade"), F.col("rank")))), F.lit(0.0)) / F.sum(F.when(F.col("best") <= k, gain(F.col("grade"), F.col("best"))))).alias("ndcg"),
    )


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over the given labels; pairs: (human, machine), others dropped."""
    p = pairs.where(F.col("human").isin(*labels) & F.col("machine").isin(*labels)).groupBy("human", "machine").agg(F.count("*").alias("n"))
    per = p.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.when((F.col("human") == x) & (F.col("machine") == x), F.col("n")).otherwise(0).alias("tp"), F.when((F.col("human") != x) & (F.col("machine") == x), F.col("n")).otherwise(0).alias("fp"), F.when((F.col("human") == x) & (F.col("machine") != x), F.col("n")).otherwise(0).alias("fn")) for x in labels])).alias("r")).select("r.*")
    s = per.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    s = s.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)))
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def threshold_grid(pairs: DataFrame) -> DataFrame:
    """(threshold, f1) of the best cut in 0.01..0.99 (first of equals); pairs: (score, positive). Counts are taken per hundredth, then summed, so no row meets every threshold."""
    b = pairs.groupBy(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("score") * 100 + F.lit(1e-9)))).cast("int").alias("bin")).agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count("*").alias("n"))
    grid = pairs.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("t"))
    # at most 101 bins meet 99 thresholds
    c = grid.join(F.broadcast(b), F.col("bin") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("found"))
    total = b.agg(F.sum("p").alias("pos"), F.sum("n").alias("all"))
    f = c.join(F.broadcast(total)).where("pos > 0 AND pos < all").withColumn("f1", 2 * F.col("tp") / (F.col("found") + F.col("pos")))
    return f.orderBy(F.desc("f1"), "t").limit(1).select((F.col("t") / 100).alias("threshold"), "f1")
