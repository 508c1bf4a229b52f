"""Further corpus queries: discussion trees with limits, coverage, matching and hydration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import merge
from gleaner.plans.text_queries import ITEMS, items, load, sql_tokens
from gleaner.session import values

QUERIES: dict = {}
ORACLES: dict = {}
KEYWORDS = [("council", 1.0), ("licence", 0.5), ("dataset", 0.8), ("museo", 1.0), ("预算", 0.7)]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH t AS (SELECT id, {sql_tokens("title")} AS ts FROM {ITEMS}), l AS (SELECT id, term, row_number() OVER (PARTITION BY term ORDER BY len(ts), id) AS rank FROM (SELECT id, ts, unnest(list_distinct(ts)) AS term FROM t) WHERE term IN ('licence', 'council', 'dataset'))
SELECT id, round(sum(1.0 / (rank + 1)), 6) AS weight, count(*) AS terms FROM l GROUP BY id""")
def reciprocal_rank_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    t = items(spark, sf, "title").select("id", T.archive_tokens(F.col("title")).alias("ts"))
    x = t.select("id", F.size("ts").alias("n"), F.explode(F.array_distinct("ts")).alias("term")).where(F.col("term").isin("licence", "council", "dataset"))
    return merge.numbered_within(x, "term", ["n", "id"], "rank").groupBy("id").agg(F.round(F.sum(1 / (F.col("rank") + 1)), 6).alias("weight"), F.count("*").alias("terms"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(title, '')) <> '') AS title, count(*) FILTER (WHERE trim(coalesce(url, '')) <> '') AS url, count(*) FILTER (WHERE trim(coalesce(lang, '')) <> '') AS lang, count(truncated) AS truncated, count(*) FILTER (WHERE len(incomplete_reasons) > 0) AS incomplete_reasons FROM documents GROUP BY source""")
def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "").alias(c)
    return load(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), some("title"), some("url"), some("lang"), F.count("truncated").alias("truncated"), F.count_if(F.size("incomplete_reasons") > 0).alias("incomplete_reasons"))


@query("""WITH c AS (SELECT id, any_value(item_id) AS item_id, max(regexp_replace(trim(parent_id), '^#comment-', '')) AS parent, min(created_at) AS created_at FROM comments GROUP BY id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at, id) AS place FROM c QUALIFY place <= 20)
SELECT k.item_id, k.id, k.place, p.id AS parent_kept FROM k LEFT JOIN k p ON k.parent = p.id AND k.item_id = p.item_id""")
def tree_build_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 comments of each item; a comment whose parent is not among them becomes a root."""
    c = load(spark, sf, "comments").groupBy("id").agg(F.first("item_id").alias("item_id"), F.max(F.regexp_replace(F.trim("parent_id"), "^#comment-", "")).alias("parent"), F.min("created_at").alias("created_at"))
    k = c.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("created_at", "id")).cast("bigint")).where("place <= 20")
    p = k.select(F.col("id").alias("parent"), "item_id", F.col("id").alias("parent_kept"))
    return k.join(p, ["item_id", "parent"], "left").select("item_id", "id", "place", "parent_kept")


@query("""WITH r AS (SELECT id, item_id, unnest(replies) AS child FROM (SELECT DISTINCT id, item_id, replies FROM comments)), x AS (SELECT DISTINCT item_id, id, child FROM r)
SELECT x.item_id, count(*) AS reported, count(c.id) AS captured FROM x LEFT JOIN (SELECT DISTINCT id FROM comments) c ON x.child = c.id GROUP BY x.item_id""")
def reply_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "comments")
    x = c.select("item_id", "id", F.explode("replies").alias("child")).distinct()
    known = c.select(F.col("id").alias("kid")).distinct()
    return x.join(known, F.col("child") == F.col("kid"), "left").groupBy("item_id").agg(F.count("*").alias("reported"), F.count("kid").alias("captured"))


@query(f"SELECT source_type, time_basis, count(*) AS n, count(DISTINCT publisher) AS publishers FROM {ITEMS} GROUP BY GROUPING SETS ((source_type), (time_basis), (source_type, time_basis), ())")
def stats_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "source_type", "time_basis", "publisher")
    return d.cube("source_type", "time_basis").agg(F.count("*").alias("n"), F.countDistinct("publisher").alias("publishers"))


@query(f"SELECT source_type, count(*) AS n FROM {ITEMS} WHERE source_type NOT IN (SELECT source_type FROM {ITEMS} WHERE run_id = (SELECT max(run_id) FROM corpus_items) AND source_type IS NOT NULL) GROUP BY source_type ORDER BY n DESC, source_type LIMIT 4")
def untried_families(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "source_type", "run_id")
    last = F.broadcast(d.agg(F.max("run_id").alias("run_id")))  # one row
    tried = d.join(last, "run_id", "left_semi").select("source_type").distinct()
    return d.join(tried, "source_type", "left_anti").groupBy("source_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_type").limit(4)


@query(f"""WITH k AS (SELECT * FROM (VALUES ('council', 1.0), ('licence', 0.5), ('dataset', 0.8), ('museo', 1.0), ('预算', 0.7)) AS t(term, w)), t AS (SELECT id, unnest(list_distinct({sql_tokens("title")})) AS term FROM {ITEMS})
SELECT id, round(CAST(sum(w) AS DOUBLE) / 4.0, 6) AS score FROM t JOIN k USING (term) GROUP BY id HAVING sum(w) / 4.0 >= 0.2""")
def interest_matching(spark: SparkSession, sf: str) -> DataFrame:
    k = F.broadcast(values(spark, KEYWORDS, "term string, w double"))  # the user's keywords
    t = items(spark, sf, "title").select("id", F.explode(F.array_distinct(T.archive_tokens(F.col("title")))).alias("term"))
    return t.join(k, "term").groupBy("id").agg(F.round(F.sum("w") / 4.0, 6).alias("score")).where("score >= 0.2")


@query(f"""WITH u AS (SELECT url, min(id) AS id FROM {ITEMS} WHERE url IS NOT NULL GROUP BY url), t AS (SELECT title, min(id) AS id FROM {ITEMS} WHERE title IS NOT NULL GROUP BY title)
SELECT d.doc_id, coalesce(u.id, t.id) AS item, CASE WHEN u.id IS NOT NULL THEN 'url' WHEN t.id IS NOT NULL THEN 'title' END AS via FROM documents d LEFT JOIN u ON d.url = u.url LEFT JOIN t ON d.title = t.title""")
def reference_to_item(spark: SparkSession, sf: str) -> DataFrame:
    i = items(spark, sf, "url", "title")
    u = i.where("url IS NOT NULL").groupBy("url").agg(F.min("id").alias("by_url"))
    t = i.where("title IS NOT NULL").groupBy("title").agg(F.min("id").alias("by_title"))
    d = load(spark, sf, "documents").select("doc_id", "url", "title").join(u, "url", "left").join(t, "title", "left")
    return d.select("doc_id", F.coalesce("by_url", "by_title").alias("item"), F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_title").isNotNull(), "title").alias("via"))


@query(f"WITH u AS (SELECT title, any_value(id) AS id, any_value(length(content)) AS chars FROM {ITEMS} WHERE title IS NOT NULL GROUP BY title HAVING count(*) = 1) SELECT d.doc_id, u.id, u.chars FROM documents d LEFT JOIN u ON d.title = u.title")
def hydrate_unambiguous(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies by title, only where the title names one item."""
    u = items(spark, sf, "title", "content").where("title IS NOT NULL").groupBy("title").agg(F.first("id").alias("id"), F.first(F.length("content").cast("bigint")).alias("chars"), F.count("*").alias("n")).where("n = 1").drop("n")
    return load(spark, sf, "documents").select("doc_id", "title").join(u, "title", "left").select("doc_id", "id", "chars")


@query("WITH e AS (SELECT DISTINCT item_id, platform, collected_at, m.key AS metric, m.value AS v FROM (SELECT item_id, platform, collected_at, unnest(map_entries(metrics)) AS m FROM engagement_snapshots) WHERE m.value IS NOT NULL) SELECT item_id, platform, metric, arg_max(v, (collected_at, v)) - arg_min(v, (collected_at, v)) AS growth, count(*) AS points FROM e GROUP BY item_id, platform, metric")
def engagement_growth(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "engagement_snapshots").select("item_id", "platform", "collected_at", F.explode("metrics").alias("metric", "v")).where("v IS NOT NULL").distinct()
    o = F.struct("collected_at", "v")
    return e.groupBy("item_id", "platform", "metric").agg((F.max_by("v", o) - F.min_by("v", o)).alias("growth"), F.count("*").alias("points"))


@query(f"WITH a AS (SELECT id, title, source_type FROM {ITEMS} WHERE title IS NOT NULL), k AS (SELECT id, source_type, lower(regexp_replace(regexp_replace(title, '\\s+[|_–—-]\\s+[^|]{{2,30}}$', ''), '[\\s!-/:-@\\[-`{{-~，。！？、：；“”‘’（）《》【】·…—]+', '', 'g')) AS k FROM a) SELECT k AS story, min(id) AS head, count(*) AS n, count(DISTINCT source_type) AS families FROM k GROUP BY k HAVING count(*) > 1")
def story_merge_titles(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "title", "source_type").where("title IS NOT NULL").select("id", "source_type", T.normal_title(F.col("title")).alias("story"))
    return d.groupBy("story").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.countDistinct("source_type").alias("families")).where("n > 1")
