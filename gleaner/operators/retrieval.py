"""Lexical ranking, hybrid re-ranking, diversity and rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import archive_tokens
from gleaner.session import cut, values

K1, B = 1.5, 0.75
SATURATION, MIN_BODY, LEAD, DECAY = 2000, 400, 0.6, 0.72


FEW_TERMS = 2000


def postings(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, len): the inverted index; counted within each row, without a shuffle."""
    d = df.select(key, archive_tokens(text).alias("ts")).select(key, "ts", F.size("ts").alias("len"), F.explode(F.array_distinct("ts")).alias("term"))
    return d.select(key, "term", F.size(F.filter("ts", lambda x: x == F.col("term"))).cast("bigint").alias("tf"), "len")


def _score(hit: DataFrame, queries: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    df_ = hit.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = hit.join(df_, "term").join(F.broadcast(stats)).select(key, "term", part.alias("s"))  # stats is one row
    return queries.join(scored, "term").groupBy("query_id", key).agg(F.sum("s").alias("score")).where("score > 0")


def bm25(df: DataFrame, key: str, text: Column, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) of all texts that share a term; ``queries``: (query_id, term), distinct; keys are unique.

    One pass over the texts: each row keeps its length and those of its tokens
    that are query terms, which is all that is written. Up to ``FEW_TERMS``
    different terms are tested within the row; more are met by a join.
    """
    few = [r[0] for r in queries.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    ts = archive_tokens(text)
    if len(few) <= FEW_TERMS:
        kept = F.filter("ts", lambda x: x.isin(*few)) if few else F.array().cast("array<string>")
        d = cut(df.select(key, ts.alias("ts")).select(key, F.size("ts").alias("len"), kept.alias("ts")), "hits")
        hit = d.where(F.size("ts") > 0).select(key, "ts", "len", F.explode(F.array_distinct("ts")).alias("term"))
        hit = hit.select(key, "term", F.size(F.filter("ts", lambda x: x == F.col("term"))).alias("tf"), "len")
    else:
        d = df.select(key, F.size(ts).alias("len"))
        hit = postings(df, key, text).join(queries.select("term").distinct(), "term", "left_semi")
    stats = d.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg"))
    return _score(hit, queries, stats, key)


INDEX_BUCKETS = 64


def build_index(df: DataFrame, key: str, text: Column, path: str) -> None:
    """A written inverted index: postings laid out by a hash of the term, sorted by it, and the collection's two numbers."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(INDEX_BUCKETS)).cast("int")
    p = postings(df, key, text).withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("term")
    p.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    df.select(F.size(archive_tokens(text)).alias("len")).agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg")).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(index: DataFrame, stats: DataFrame, terms: list[tuple[str, str]], key: str) -> DataFrame:
    """As :func:`bm25`, from an index of :func:`build_index`; reads only the buckets and row groups of the terms asked for. terms: (query_id, term)."""
    spark = index.sparkSession
    q = values(spark, sorted(set(terms)), "query_id string, term string")
    buckets = values(spark, [(t,) for t in sorted({t for _, t in terms})], "term string").select(F.pmod(F.xxhash64("term"), F.lit(INDEX_BUCKETS)).cast("int")).distinct().collect()
    hit = index.where(F.col("bucket").isin([r[0] for r in buckets]) & F.col("term").isin(sorted({t for _, t in terms}))).select(key, "term", "tf", "len")
    return _score(hit, q, stats, key)


def hybrid_score(title: Column, snippet: Column, length: Column, trust: Column, terms: list[str], prefer_body: bool = True) -> Column:
    """Relevance, body and trust weighed together, with a bonus where the title leads with a term."""
    def norm(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "\\s+", "")

    nt, nb = norm(title), norm(F.concat(F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    total, hit = 0.0, F.lit(0.0)
    limit = F.greatest(F.floor(F.length(nt) * LEAD).cast("int"), F.lit(1))
    room = limit
    for t in terms:
        low = "".join(t.lower().split())
        w = 1.0 + math.log1p(max(len(t) - 2, 0))
        total += w
        hit = hit + F.when(nt.contains(low), w).when(nb.contains(low), w * 0.30).otherwise(0.0)
        at = F.instr(nt, low) - 1
        room = F.when((at >= 0) & (at < room), F.greatest(room, at + len(low))).otherwise(room)
    leads = F.lit(False)
    for t in terms:
        leads = leads | F.substring(nt, F.lit(1), room).contains("".join(t.lower().split()))
    rel = hit / total
    n = F.coalesce(length, F.lit(0))
    body = F.least(F.log1p(n.cast("double")) / math.log1p(SATURATION), F.lit(1.0))
    tr = F.when(F.coalesce(trust, F.lit(0.0)) == 0, 0.5).otherwise(trust)
    if prefer_body:
        s = rel * 0.45 + F.when(n < MIN_BODY, body * 0.15).otherwise(body) * 0.35 + tr * 0.20
    else:
        s = rel * 0.60 + body * 0.20 + tr * 0.20
    return s + F.when(leads, 0.12).otherwise(0.0)


def diversify(ranked: DataFrame, publisher: str, score: str, tie: str, most: int) -> DataFrame:
    """Each further row of a publisher, in score order, loses by the decay; ``final`` is the new score. Rows that can be among the best ``most``.

    No row behind its publisher's first ``most`` can be among them, so that limit
    on the rank comes first and a hot publisher is cut down before the shuffle.
    """
    w = Window.partitionBy(F.coalesce(F.col(publisher), F.lit("?"))).orderBy(F.desc(score), tie)
    r = ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return r.withColumn("final", F.col(score) * F.pow(F.lit(DECAY), F.col("_r") - 1)).drop("_r")


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of differing length or no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for v in (a, b)]
    return F.when((F.size(a) == F.size(b)) & (n[0] > 0) & (n[1] > 0), dot / (n[0] * n[1])).otherwise(F.lit(0.0))


def ranked(df: DataFrame, key: str, score: str) -> DataFrame:
    """``df`` with its rank from 1 (score descending, then key) over all rows, without one task seeing them all.

    A range-partitioned sort gives each partition a run of the order; the
    driver sees one count per partition and hands every partition its offset.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    s = df.repartitionByRange(n, F.desc(score), F.col(key)).sortWithinPartitions(F.desc(score), key)
    s = cut(s.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    at, rows = 0, []
    for r in s.groupBy("_p").count().orderBy("_p").collect():
        rows.append((r["_p"], at))
        at += r["count"]
    off = values(df.sparkSession, rows, "_p int, _o bigint")
    return s.join(F.broadcast(off), "_p").withColumn("rank", F.col("_o") + F.col("_i") + 1).drop("_p", "_i", "_o")


def fused_by_rank(lists: list[DataFrame], key: str, score: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of whole lists of any length."""
    out = None
    for x in lists:
        r = ranked(x.select(key, score), key, score).select(key, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("p"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy(key).agg(F.sum("p").alias("rrf"))
