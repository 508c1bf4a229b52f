"""Readers and writers over the tables: payloads, exports, journals and digests made from rows and read back, sinks; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import merge, trust
from gleaner.plans.text_queries import ITEMS, items, load
from gleaner.session import shared_dir, values
from gleaner.sources import exports, json_rows, markup, sinks
from gleaner.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}
NOW = "2025-09-15 12:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"


SPEC = json_rows.SourceSpec("demo", "item", "data.list", title=("head.title", "title"), url=("link",), author=("by",), date=("at",), body=("text",), metrics={"score": "n"}, url_prefix="https://host.example")


@query(f"""SELECT regexp_replace(trim(substr(title, 1, 300)), '\\s+', ' ', 'g') AS title, CASE WHEN regexp_matches(url, '^https?://') THEN url END AS url, length(id) AS score, CASE WHEN trim(coalesce(title, '')) = '' THEN 'no_title' WHEN url IS NULL THEN 'no_url' END AS problem
FROM {ITEMS} WHERE title IS NULL OR NOT regexp_matches(title, '[<&\\\\]')""")
def json_rows_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Items wrapped as payloads of an endpoint and read by its declared paths; unusable rows keep their reason."""
    i = items(spark, sf, "title", "url").where("title IS NULL OR NOT title rlike '[<&\\\\\\\\]'")
    row = F.struct(F.struct("title").alias("head"), F.col("url").alias("link"), F.length("id").alias("n"))
    p = i.select(F.to_json(F.struct(F.struct(F.array(row).alias("list")).alias("data"))).alias("value"))
    r = json_rows.parse(p, SPEC, F.lit(NOW).cast("timestamp"))
    return r.select("title", "url", F.col("metrics")["score"].alias("score"), "problem")


@query(f"""WITH b AS (SELECT id, lower(concat_ws(' ', title, content)) AS t FROM {ITEMS}) SELECT id FROM b WHERE CAST(contains(t, '市议') AS INT) * 2 + CAST(contains(t, '议会') AS INT) * 2 + CAST(contains(t, '会取') AS INT) * 2 + CAST(contains(t, '取消') AS INT) * 2 >= 4""")
def phrase_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that mention a phrase: all Latin words, half of the pairs of a run of Han characters."""
    d = items(spark, sf, "title", "content").withColumnRenamed("content", "text")
    return json_rows.keep_mentioning(d, "市议会取消").select("id")


@query("SELECT url, arg_max(text, (length(text), doc_id)) AS text, arg_min(title, doc_id) FILTER (WHERE trim(title) <> '') AS title, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE source IS NOT NULL)), ','), '') AS merged_sources, count(*) AS n FROM documents WHERE url IS NOT NULL GROUP BY url")
def richest_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").where("url IS NOT NULL").select("url", "doc_id", "text", "title", "source")
    r = merge.richest(d, "url", "text", ["doc_id"], ["title"], "source")
    return r.select("url", "text", "title", F.array_join("merged_sources", ",").alias("merged_sources"), "n")


@query(f"SELECT id, CASE s.provenance WHEN 'ocr' THEN coalesce(s.confidence, 0.5) WHEN 'author' THEN 1.0 WHEN 'transcript' THEN 0.95 WHEN 'vlm' THEN 0.6 WHEN 'legacy_marker' THEN 0.8 WHEN 'manual_export' THEN 0.85 ELSE 0.8 END AS factor FROM (SELECT id, unnest(sections) AS s FROM {ITEMS})")
def provenance_factor(spark: SparkSession, sf: str) -> DataFrame:
    """How far each section carries its author's voice."""
    d = items(spark, sf, "sections").select("id", F.explode("sections").alias("s"))
    return d.select("id", trust.provenance_factor(F.col("s.provenance"), F.col("s.confidence")).alias("factor"))


@query(f"SELECT id, CASE WHEN length(id) % 2 = 0 THEN 'first' ELSE 'second' END AS batch FROM {ITEMS}")
def append_items_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches into an append-only table; what is stored first stays."""
    d, at = items(spark, sf), _place(spark, "items")
    sinks.append_items(spark, at, d.where("length(id) % 2 = 0").withColumn("batch", F.lit("first")))
    sinks.append_items(spark, at, d.withColumn("batch", F.lit("second")))
    return spark.read.parquet(at)


@query("SELECT item_id, count(*) AS added FROM (SELECT DISTINCT item_id, platform, collected_at FROM engagement_snapshots WHERE len(map_keys(metrics)) > 0 EXCEPT SELECT item_id, platform, collected_at FROM engagement_snapshots WHERE length(item_id) % 2 = 0) GROUP BY item_id")
def append_snapshots_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots that are new against those stored; a repeated batch adds nothing."""
    e = load(spark, sf, "engagement_snapshots")
    return sinks.append_snapshots(e.where("length(item_id) % 2 = 0"), e).groupBy("item_id").agg(F.count("*").alias("added"))


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def upsert_latest_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The newest row of each key over what is stored and what comes in."""
    e = load(spark, sf, "events").select("user_id", "event_type", "event_id")
    return sinks.upsert_latest(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), ["user_id", "event_type"], "event_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def staged_run_store(spark: SparkSession, sf: str) -> DataFrame:
    """A run's stage written and read back as JSON rows."""
    at = _place(spark, "run")
    e = load(spark, sf, "events").select("event_id", "event_type", "value")
    for stage in ("raw", "scored", "raw"):  # writing the first again makes the later one invalid
        sinks.save_stage(e, at, stage)
    return spark.read.schema("event_id long, event_type string, value double").json(f"{at}/raw").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT coalesce(CASE WHEN trim(coalesce(title, '')) = '' THEN 'no_title' WHEN url IS NULL THEN 'no_url_or_locator' END, 'ok') AS problem, count(*) AS n FROM {ITEMS} WHERE source_type IS NOT NULL GROUP BY problem")
def export_import(spark: SparkSession, sf: str) -> DataFrame:
    """Items written as a user's exports, read back and validated; each row with its reason."""
    at = _place(spark, "export")
    i = items(spark, sf, "source_type", "title", "url").where("source_type IS NOT NULL")
    i.select(F.to_json(F.struct(F.array(F.struct("source_type", "title", "url")).alias("items"))).alias("value")).repartition(4).write.text(at)
    raw = spark.read.text(at).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"items array<struct<{exports._ddl_struct(exports.ITEM)}>>").alias("x"))
    rows = raw.select("file", F.posexplode_outer("x.items").alias("pos", "i")).select("file", "pos", "i.*")
    return exports.validated(rows).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_type || ':' || user_id AS row FROM events")
def journal_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Journal batches replayed into a table keyed by row, twice; rejects stop nothing."""
    at = _place(spark, "journal")
    e = load(spark, sf, "events").groupBy(F.expr("event_id div 500").alias("b")).agg(F.collect_list(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))).alias("rows"))  # batches of 500 events
    line = F.to_json(F.struct(F.lit(1).alias("version"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("batch_id"), F.lit("c").alias("corpus_id"), F.lit("2025-01-01T00:00:00").alias("created_at"), "rows"))
    e.select(line.alias("value")).repartition(3).write.text(f"{at}/in")
    for _ in range(2):
        ingest.journal_stream(spark, f"{at}/in", f"{at}/out", f"{at}/bad", at.rsplit("-", 1)[-1])
    return ingest.stored(spark, f"{at}/out").select("row")


@query("SELECT doc_id, title, url FROM documents WHERE url IS NOT NULL AND title IS NOT NULL AND NOT regexp_matches(title, '[\\[\\]\\\\`*_{}<>]') AND regexp_matches(url, '^[^)]+$')")
def digest_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as markdown digests, one file a task, and read back from their headings."""
    at = _place(spark, "digests")
    d = load(spark, sf, "documents").where("url IS NOT NULL AND title IS NOT NULL").where(~F.col("title").rlike("[\\[\\]\\\\`*_{}<>]") & F.col("url").rlike("^[^)]+$")).select("doc_id", "title", "url")
    d.select(F.concat(F.lit("## ["), "title", F.lit("]("), "url", F.lit(")\n\n"), F.col("doc_id").cast("string"), F.lit("\n\n")).alias("value")).write.text(at)
    got = exports.read_digests(spark, at)
    return got.select(F.trim("summary").cast("bigint").alias("doc_id"), "title", "url")


@query("SELECT CAST(s AS DATE) AS start, least(CAST(s + INTERVAL 30 DAY AS DATE), DATE '2025-01-01') AS \"end\" FROM generate_series(TIMESTAMP '2023-01-01', TIMESTAMP '2024-12-31', INTERVAL 30 DAY) AS t(s)")
def date_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Contiguous windows of a backfill, the newest first."""
    return json_rows.date_windows(spark, "2023-01-01", "2025-01-01", 30)


@query("SELECT * FROM (VALUES ('1.2万', 12000), ('3亿', 300000000), ('5k', 5000), ('12,345', 12345), ('7', 7), ('none', NULL), ('2m', 2000000)) AS t(raw, n)")
def human_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = values(spark, [(x,) for x in ("1.2万", "3亿", "5k", "12,345", "7", "none", "2m")], "raw string")
    return d.select("raw", T.human_count(F.col("raw")).cast("int").alias("n"))


@query("""SELECT raw, CAST(t AS TIMESTAMPTZ) AS at FROM (VALUES ('昨天 20:25', TIMESTAMP '2025-09-14 20:25:00'), ('3天前', TIMESTAMP '2025-09-12 12:00:00'), ('08-30', TIMESTAMP '2025-08-30 00:00:00'), ('12-24', TIMESTAMP '2024-12-24 00:00:00'), ('1756500000', TIMESTAMP '2025-08-29 20:40:00'), ('1756500000123', TIMESTAMP '2025-08-29 20:40:00'),
 ('2025-08-30T01:02:03Z', TIMESTAMP '2025-08-30 01:02:03'), ('Thu, 28 Aug 2025 07:00:00 GMT', TIMESTAMP '2025-08-28 07:00:00'), ('2 hours ago', TIMESTAMP '2025-09-15 10:00:00'), ('soon', NULL)) AS v(raw, t)""")
def dates_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    raw = ["昨天 20:25", "3天前", "08-30", "12-24", "1756500000", "1756500000123", "2025-08-30T01:02:03Z", "Thu, 28 Aug 2025 07:00:00 GMT", "2 hours ago", "soon"]
    return values(spark, [(x,) for x in raw], "raw string").select("raw", T.parse_when(F.col("raw"), F.lit(NOW).cast("timestamp")).alias("at"))


@query("SELECT doc_id, title AS text FROM documents WHERE title IS NOT NULL AND length(title) BETWEEN 12 AND 200 AND NOT regexp_matches(title, '[<>&\\\\]|\\s\\s|^\\s|\\s$')")
def html_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Titles put into pages as headings and read back by the generic reader."""
    d = load(spark, sf, "documents").where(F.col("title").isNotNull() & F.length("title").between(12, 200) & ~F.col("title").rlike("[<>&\\\\]|\\s\\s|^\\s|\\s$"))
    page = F.concat(F.lit("<html><body><h2 class='t'><b>"), "title", F.lit("</b></h2><p>short</p></body></html>"))
    return markup.html_headlines(d.select("doc_id", page.alias("h")), "doc_id", "h").select("doc_id", "text")


@query("SELECT doc_id, title, url FROM documents WHERE title IS NOT NULL AND url IS NOT NULL AND NOT regexp_matches(title, '[<>&]|\\s\\s|^\\s|\\s$') AND NOT contains(url, '&')")
def feed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and links put into feeds, one a row, and read back."""
    d = load(spark, sf, "documents").where("title IS NOT NULL AND url IS NOT NULL").where(~F.col("title").rlike("[<>&]|\\s\\s|^\\s|\\s$") & ~F.contains(F.col("url"), F.lit("&")))
    feed = F.concat(F.lit("<rss version='2.0'><channel><title>c</title><item><title>"), "title", F.lit("</title><link>"), "url", F.lit("</link></item></channel></rss>"))
    return markup.read_feeds(d.select("doc_id", feed.alias("b")), "doc_id", "b").select("doc_id", "title", "url")
