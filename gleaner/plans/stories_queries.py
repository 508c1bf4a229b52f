"""Merging across sources, scores, sections, filters and queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import merge
from gleaner.operators import stories as S
from gleaner.plans.text_queries import ITEMS, items, load

QUERIES: dict = {}
ORACLES: dict = {}
NOW = "2025-09-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql_normal(t: str) -> str:
    for a, b in S.ENTITIES:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    signs = S.SIGNS.replace("'", "''")
    return f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '{S.SITE_SUFFIX}', ''), '{S.COLUMN_PREFIX}', ''), '[\\s\\x{{3000}}_]+', '', 'g'), '{signs}', '', 'g'))"


def _sql_once(s: str) -> str:
    return f"(CASE WHEN length({s}) // 2 >= 6 AND substr({s}, 1, length({s}) // 2 - 2) = substr({s}, length({s}) // 2 + 1, length({s}) // 2 - 2) THEN substr({s}, 1, length({s}) // 2) ELSE {s} END)"


_KEYED = f"""s AS (SELECT id, title, url, publisher, trust, content, published_at, list_transform(regexp_split_to_array(trim(title), '{S.BREAKS}'), lambda x: {_sql_normal("x")}) AS n, {_sql_normal("trim(title)")} AS w FROM {ITEMS}),
f AS (SELECT *, list_filter(list_transform(n, lambda x: {_sql_once("x")}), lambda x: length(x) >= 6) AS f, {_sql_once("w")} AS wt FROM s),
b AS (SELECT *, list_filter(f, lambda x: length(x) = list_max(list_transform(f, lambda y: length(y))))[1] AS best FROM f),
k AS (SELECT *, coalesce(substr(regexp_replace(coalesce(best, CASE WHEN length(wt) >= 6 THEN wt END), '{S.LEAD}', ''), 1, 20), CASE WHEN length(coalesce(url, '')) > 0 THEN 'u:' || substr(url, 1, 64) END) AS key FROM b)"""


@query(f"SELECT id, {_sql_normal('title')} AS normal, {_sql_once(_sql_normal('title'))} AS once FROM {ITEMS} WHERE title IS NOT NULL")
def title_normaliser(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "title").where("title IS NOT NULL").select("id", S.normal(F.col("title")).alias("normal"))
    return d.withColumn("once", S.without_repeat(F.col("normal")))


@query(f"SELECT id, {_sql_once(_sql_normal(chr(39) + chr(39) + ' || title || ' + chr(39) + ' - ' + chr(39) + ' || title'))} AS once FROM {ITEMS} WHERE title IS NOT NULL")
def self_repeat_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Titles written twice, as some reprinting sites do, come out once."""
    d = items(spark, sf, "title").where("title IS NOT NULL")
    return d.select("id", S.without_repeat(S.normal(F.concat("title", F.lit(" - "), "title"))).alias("once"))


@query(f"WITH {_KEYED} SELECT id, key FROM k")
def cluster_key(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf, "title", "url").select("id", S.cluster_key(F.col("title"), F.col("url")).alias("key"))


_PREFIX = f"""{_KEYED}, u AS (SELECT DISTINCT key FROM k WHERE key IS NOT NULL),
p AS (SELECT a.key, arg_min(b.key, length(b.key)) AS bucket FROM u a JOIN u b ON starts_with(a.key, b.key) AND length(b.key) >= 8 WHERE NOT starts_with(a.key, 'u:') AND NOT starts_with(b.key, 'u:') GROUP BY a.key),
sc AS (SELECT k.id, coalesce(p.bucket, k.key) AS bucket, trim(publisher) AS publisher, content AS body, {{score}} AS score FROM k LEFT JOIN p USING (key) WHERE k.key IS NOT NULL),
m AS (SELECT bucket, arg_max(id, (score, id)) AS head, max(score) AS top, count(*) AS variants, max(length(coalesce(body, ''))) AS body_chars, count(DISTINCT publisher) FILTER (WHERE length(publisher) > 0) AS independent FROM sc GROUP BY bucket),
r AS (SELECT *, least(top + greatest(0.0, least((independent - 1) * 0.06, 0.18)), 1.0) AS merged_score FROM m)"""
_FRESH = f"CASE WHEN published_at IS NULL THEN 0.0 WHEN date_diff('day', CAST(published_at AS DATE), DATE '{NOW[:10]}') < 0 THEN 0.0 WHEN date_diff('day', CAST(published_at AS DATE), DATE '{NOW[:10]}') <= 1 THEN 0.12 WHEN date_diff('day', CAST(published_at AS DATE), DATE '{NOW[:10]}') <= 3 THEN 0.06 WHEN date_diff('day', CAST(published_at AS DATE), DATE '{NOW[:10]}') <= 7 THEN 0.02 ELSE 0.0 END"
_GOOD = " OR ".join(f"contains(lower(coalesce(url, '')), '{h}')" for h in S.GOOD_HOSTS)
_SCORE = f"round(least(1.0, CASE WHEN trust IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, trust)) END + ({_FRESH}) + CASE WHEN length(coalesce(content, '')) >= 1000 THEN 0.08 WHEN length(coalesce(content, '')) >= 400 THEN 0.04 ELSE 0.0 END + CASE WHEN {_GOOD} THEN 0.08 ELSE 0.0 END), 6)"
_PREFIX = _PREFIX.replace("{score}", _SCORE)


def _stories(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "title", "url", "publisher", "trust", "content", "published_at")
    none = F.lit(None).cast("double")
    fresh = S.freshness_bonus(F.to_date("published_at"), F.lit(NOW[:10]).cast("date"))
    sc = F.round(S.score(none, none, F.col("trust"), fresh, F.col("content"), F.col("url")), 6)
    d = d.select("id", "publisher", F.col("content").alias("body"), sc.alias("score"), S.cluster_key(F.col("title"), F.col("url")).alias("key")).where("key IS NOT NULL")
    return S.merged(d.join(S.prefix_buckets(d), "key"))


@query(f"WITH {_PREFIX} SELECT bucket, head, variants, independent, body_chars, round(merged_score, 6) AS merged_score FROM r")
def story_merge_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Stories whose title keys begin alike are one, with its best head, longest body and a bonus for independent voices."""
    return _stories(spark, sf).select("bucket", "head", "variants", "independent", "body_chars", F.round("merged_score", 6).alias("merged_score"))


@query(f"WITH {_PREFIX} SELECT bucket, independent, round(merged_score, 6) AS merged_score FROM r ORDER BY body_chars >= 400 DESC, round(merged_score, 6) DESC, independent DESC, bucket LIMIT 100")
def merge_sort(spark: SparkSession, sf: str) -> DataFrame:
    d = _stories(spark, sf).select("bucket", "independent", "body_chars", F.round("merged_score", 6).alias("merged_score"))
    return d.orderBy(F.desc(F.col("body_chars") >= 400), F.desc("merged_score"), F.desc("independent"), "bucket").limit(100).drop("body_chars")


@query(f"WITH {_PREFIX} SELECT count(*) AS total, count(*) FILTER (WHERE body_chars >= 400) AS with_body, count(*) FILTER (WHERE independent > 1) AS multi_source, round(avg(greatest(independent, 1)), 2) AS avg_independent FROM r")
def merge_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = _stories(spark, sf)
    return d.agg(F.count("*").alias("total"), F.count_if(F.col("body_chars") >= 400).alias("with_body"), F.count_if(F.col("independent") > 1).alias("multi_source"), F.round(F.avg(F.greatest("independent", F.lit(1))), 2).alias("avg_independent"))


@query(f"SELECT id, {_SCORE} AS score FROM {ITEMS}")
def cross_layer_score(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("double")
    fresh = S.freshness_bonus(F.to_date("published_at"), F.lit(NOW[:10]).cast("date"))
    return items(spark, sf, "url", "trust", "content", "published_at").select("id", F.round(S.score(none, none, F.col("trust"), fresh, F.col("content"), F.col("url")), 6).alias("score"))


@query(f"""WITH u AS (SELECT *, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.category') END AS cat, regexp_replace(regexp_replace(lower(url), '\\?.*$', ''), '/+$', '') AS k FROM {ITEMS} WHERE url IS NOT NULL)
SELECT k AS url_key, arg_max(id, (length(coalesce(content, '')), id)) AS richest, arg_min(author, (fetched_at, id)) FILTER (WHERE trim(author) <> '') AS author, arg_min(cat, (fetched_at, id)) FILTER (WHERE cat IS NOT NULL) AS category,
 array_to_string(list_sort(list(DISTINCT source_type)), ',') AS merged_sources, sum(len(sections)) AS sections, count(*) AS n FROM u GROUP BY k""")
def url_merge_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one address: the richest content wins, other fields are filled from the first that has them, sections are put together."""
    d = items(spark, sf, "url", "content", "author", "metadata", "source_type", "sections", "fetched_at").where("url IS NOT NULL")
    d = d.withColumn("url_key", F.regexp_replace(F.regexp_replace(F.lower("url"), "\\?.*$", ""), "/+$", "")).withColumn("category", F.get_json_object("metadata", "$.category"))
    o = F.struct("fetched_at", "id")
    first = lambda c, ok: F.min_by(c, F.when(ok, o)).alias(c)
    per = d.groupBy("url_key").agg(
        F.max_by("id", F.struct(F.length(F.coalesce("content", F.lit(""))), "id")).alias("richest"), first("author", F.trim("author") != ""), first("category", F.col("category").isNotNull()),
        F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("merged_sources"), F.sum(F.size("sections")).alias("sections"), F.count("*").alias("n"),
    )
    return per


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS size FROM documents WHERE source IS NOT NULL")
def section_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each entry within its section and the section's size (counts pre-aggregated, then joined)."""
    d = load(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", "source")
    return merge.numbered_within(d, "source", ["doc_id"], "place").join(d.groupBy("source").agg(F.count("*").alias("size")), "source").select("doc_id", "source", F.col("place").cast("bigint").alias("place"), "size")


@query(f"""SELECT CASE WHEN source_type = 'rss' THEN 'rss:' || coalesce(publisher, 'unknown') WHEN source_type = 'google_news' THEN 'news:' || coalesce(publisher, author, 'unknown') ELSE source_type || ':' || coalesce(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.category'), author, 'unknown') END AS label, count(*) AS n FROM {ITEMS} WHERE source_type IS NOT NULL GROUP BY label""")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    un = F.lit("unknown")
    t = F.col("source_type")
    lab = F.when(t == "rss", F.concat(F.lit("rss:"), F.coalesce("publisher", un))).when(t == "google_news", F.concat(F.lit("news:"), F.coalesce("publisher", "author", un)))
    lab = lab.otherwise(F.concat(t, F.lit(":"), F.coalesce(F.get_json_object("metadata", "$.category"), "author", un)))
    return items(spark, sf, "source_type", "publisher", "author", "metadata").where(t.isNotNull()).groupBy(lab.alias("label")).agg(F.count("*").alias("n"))


@query(f"""SELECT id, CASE WHEN lv >= 0 THEN greatest(0.0, least(1.0, 0.3 + lv / 20.0)) WHEN vf THEN 0.9 WHEN trim(coalesce(author, '')) <> '' THEN 0.5 ELSE 0.4 END AS rank
FROM (SELECT id, author, CASE WHEN json_valid(metadata) THEN TRY_CAST(json_extract_string(metadata, '$.score') AS DOUBLE) / 50 END AS lv, coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.category') = 'science' END, false) AS vf FROM {ITEMS})""")
def author_rank(spark: SparkSession, sf: str) -> DataFrame:
    """A source-visible level (here from the metadata's score), verification, a name, or nothing."""
    from gleaner.operators import trust

    d = items(spark, sf, "author", "metadata")
    level = F.get_json_object("metadata", "$.score").try_cast("double") / 50
    verified = F.coalesce(F.get_json_object("metadata", "$.category") == "science", F.lit(False))
    return d.select("id", trust.author_rank(F.col("author"), level, verified).alias("rank"))


_TRACK = "^(utm_|(ops_request_misc|request_id|biz_id|spm|share_token|share_source|from_source|xsec_token|xsec_source|channel_type|vd_source|scene|srcid|dist_request_id)=)"


@query(f"WITH u AS (SELECT id, url, regexp_extract(url, '^[^?#]*') AS head, regexp_extract(url, '\\?([^#]*)', 1) AS q, regexp_extract(url, '#.*$') AS frag FROM {ITEMS} WHERE url IS NOT NULL) SELECT id, head || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END || frag AS clean FROM (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACK}')) AS k FROM u)")
def crawl_clean_url(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf, "url").where("url IS NOT NULL").select("id", T.without_tracking(F.col("url")).alias("clean"))


@query(r"""SELECT id, CASE WHEN NOT regexp_matches(url, '(?i)^https?://') THEN 'scheme' WHEN coalesce(a, '') = '' THEN 'no_host' WHEN contains(a, '@') THEN 'credentials' WHEN TRY_CAST(regexp_extract(a, ':(\d+)$', 1) AS BIGINT) NOT BETWEEN 1 AND 65535 THEN 'port'
 WHEN regexp_matches(h, '(^|\.)localhost$') THEN 'localhost' WHEN regexp_matches(h, '^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)[\d.]+$') OR starts_with(h, '[') THEN 'private' ELSE 'ok' END AS verdict
FROM (SELECT id, url, a, regexp_replace(regexp_replace(lower(a), ':\d+$', ''), '\.$', '') AS h FROM (SELECT id, url, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS a FROM (SELECT id, CASE length(id) % 9 WHEN 0 THEN replace(url, '://', '://u:p@') WHEN 1 THEN 'ftp://x.example/' WHEN 2 THEN 'http://192.168.0.1/a' WHEN 3 THEN 'http://localhost:80/' WHEN 4 THEN 'https://a.example:99999/' ELSE url END AS url FROM """ + ITEMS + r""" WHERE url IS NOT NULL)))""")
def url_safety(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("id") % 9
    odd = F.when(n == 0, F.replace(F.col("url"), F.lit("://"), F.lit("://u:p@"))).when(n == 1, "ftp://x.example/").when(n == 2, "http://192.168.0.1/a").when(n == 3, "http://localhost:80/").when(n == 4, "https://a.example:99999/").otherwise(F.col("url"))
    return items(spark, sf, "url").where("url IS NOT NULL").select("id", T.url_verdict(odd).alias("verdict"))


@query(f"SELECT id, regexp_matches(lower(url), '\\.pdf|/rss/articles|/link\\?|/d/|/api/') OR regexp_matches(lower(url), '^https?://[^/]+/*$') AS machine FROM {ITEMS} WHERE url IS NOT NULL")
def machine_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf, "url").where("url IS NOT NULL").select("id", T.machine_url(F.col("url"), ("\\.pdf", "/rss/articles", "/link\\?", "/d/", "/api/")).alias("machine"))


_RANK = "CASE source_type WHEN 'rss' THEN 0 WHEN 'gdelt' THEN 1 WHEN 'hackernews' THEN 2 WHEN 'v2ex' THEN 3 WHEN 'openbb' THEN 4 WHEN 'github' THEN 8 WHEN 'reddit' THEN 9 WHEN 'twitter' THEN 10 WHEN 'bilibili' THEN 11 WHEN 'youtube' THEN 12 WHEN 'google_news' THEN 13 ELSE 7 END"
# fixed values: order of source types in the queue of texts to fetch, and types that have no body to fetch
TYPE_RANK = {"rss": 0, "gdelt": 1, "hackernews": 2, "v2ex": 3, "openbb": 4, "github": 8, "reddit": 9, "twitter": 10, "bilibili": 11, "youtube": 12, "google_news": 13}
NO_BODY = ("twitter", "bilibili", "youtube", "google_news", "reddit")


@query(f"SELECT id, source_type, trust FROM {ITEMS} WHERE length(coalesce(content, '')) < 400 AND url IS NOT NULL AND source_type NOT IN {NO_BODY} AND NOT regexp_matches(lower(url), '\\.pdf|/rss/articles|/link\\?|/d/|/api/') AND NOT regexp_matches(lower(url), '^https?://[^/]+/*$') AND NOT coalesce(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.fetched') = 'failed', false) ORDER BY {_RANK}, trust DESC NULLS LAST, id LIMIT 300")
def full_text_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The texts worth fetching: every filter before the limit, types in their order, trust within them."""
    d = items(spark, sf, "source_type", "trust", "content", "url", "metadata")
    short = (F.length(F.coalesce("content", F.lit(""))) < 400) & F.col("url").isNotNull() & ~F.col("source_type").isin(*NO_BODY)
    d = d.where(short & ~T.machine_url(F.col("url"), ("\\.pdf", "/rss/articles", "/link\\?", "/d/", "/api/")) & ~F.coalesce(F.get_json_object("metadata", "$.fetched") == "failed", F.lit(False)))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])[F.col("source_type")], F.lit(7))
    return d.orderBy(rank, F.desc_nulls_last("trust"), "id").limit(300).select("id", "source_type", "trust")


@query(f"""SELECT id, trust, length(content) AS n FROM {ITEMS} WHERE length(coalesce(content, '')) >= 300 AND coalesce(url, '') <> '' AND NOT regexp_matches(url, 'github\\.com/advisories/|/cve/|nvd\\.nist\\.gov|spdx\\.org/licenses/|huggingface\\.co/|openrouter\\.ai/|npmjs\\.com/|pypi\\.org/')
 AND (regexp_matches(title, '[\\x{{4e00}}-\\x{{9fa5}}]') OR length(title) - length(replace(title, ' ', '')) >= 3) AND NOT (contains(title, '/') AND NOT contains(title, ' ')) AND title NOT IN (SELECT title FROM {ITEMS} WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 3)
 AND id NOT IN (SELECT item_id FROM engagement_snapshots WHERE item_id IS NOT NULL) ORDER BY trust DESC NULLS LAST, n DESC, id LIMIT 200""")
def editorial_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Items worth extracting claims from: long enough, an address that is no catalogue, a title that reads as prose and is no template, not claimed yet."""
    d = items(spark, sf, "title", "url", "content", "trust")
    t = F.col("title")
    fine = (F.length(F.coalesce("content", F.lit(""))) >= 300) & (F.coalesce("url", F.lit("")) != "") & ~F.col("url").rlike("github\\.com/advisories/|/cve/|nvd\\.nist\\.gov|spdx\\.org/licenses/|huggingface\\.co/|openrouter\\.ai/|npmjs\\.com/|pypi\\.org/")
    fine = fine & (t.rlike("[\\x{4e00}-\\x{9fa5}]") | (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) >= 3)) & ~(F.contains(t, F.lit("/")) & ~F.contains(t, F.lit(" ")))
    often = d.where(t.isNotNull()).groupBy("title").agg(F.count("*").alias("c")).where("c > 3").select("title")
    claimed = load(spark, sf, "engagement_snapshots").select(F.col("item_id").alias("id")).where("id IS NOT NULL").distinct()
    d = d.where(fine).join(often, "title", "left_anti").join(claimed, "id", "left_anti")
    return d.select("id", "trust", F.length("content").cast("bigint").alias("n")).orderBy(F.desc_nulls_last("trust"), F.desc("n"), "id").limit(200)


@query("""SELECT doc_id, CASE WHEN h = 'github.com' THEN CASE WHEN regexp_matches(p, '^/[^/]+/[^/]+/(issues|pull|pulls|discussions)(/|$)') THEN 'github_issues' ELSE '' END WHEN regexp_matches(h, '(^|\\.)v2ex\\.com$') THEN 'v2ex_search' WHEN regexp_matches(h, '(^|\\.)reddit\\.com$') THEN 'reddit_public' WHEN regexp_matches(h, '(^|\\.)forum\\.example$|-forum\\.example$') THEN 'forum' ELSE '' END AS key
FROM (SELECT doc_id, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS h, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://github.com/a/b/issues/' || doc_id WHEN 1 THEN 'https://www.v2ex.com/t/' || doc_id WHEN 2 THEN 'https://github.com/a/b' ELSE url END AS u FROM documents)) WHERE h IS NOT NULL""")
def community_source_key(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id") % 5
    i = F.col("doc_id").cast("string")
    u = F.when(n == 0, F.concat(F.lit("https://github.com/a/b/issues/"), i)).when(n == 1, F.concat(F.lit("https://www.v2ex.com/t/"), i)).when(n == 2, "https://github.com/a/b").otherwise(F.col("url"))
    keys = {"v2ex.com": "v2ex_search", "reddit.com": "reddit_public", "forum.example": "forum", "-forum.example": "forum"}
    return load(spark, sf, "documents").select("doc_id", "url").withColumn("u", u).where("u IS NOT NULL").select("doc_id", T.community_key(F.col("u"), keys).alias("key"))


@query("""SELECT 'documents' AS layer, count(*) AS n, count(title) AS title, count(url) AS url, 0 AS author FROM documents UNION ALL SELECT 'items', count(*), count(title), count(url), count(author) FROM """ + ITEMS + """ UNION ALL SELECT 'comments', count(*), 0, count(url), count(author) FROM comments""")
def union_all_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of layers with different columns together; what a layer lacks is null."""
    a = load(spark, sf, "documents").select(F.lit("documents").alias("layer"), "title", "url")
    b = items(spark, sf, "title", "url", "author").select(F.lit("items").alias("layer"), "title", "url", "author")
    c = load(spark, sf, "comments").select(F.lit("comments").alias("layer"), "url", "author")
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return u.groupBy("layer").agg(F.count("*").alias("n"), F.count("title").alias("title"), F.count("url").alias("url"), F.count("author").alias("author"))


@query(f"WITH v AS (SELECT url, min(id) AS id FROM {ITEMS} WHERE url IS NOT NULL GROUP BY url), d AS (SELECT url, min(doc_id) AS doc_id FROM documents WHERE url IS NOT NULL GROUP BY url) SELECT coalesce(v.url, d.url) AS url, CASE WHEN v.url IS NOT NULL THEN 'item' ELSE 'document' END AS first_seen FROM v FULL JOIN d ON v.url = d.url")
def union_of_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The union of several searches keyed by address; the first variant that has it wins."""
    v = items(spark, sf, "url").where("url IS NOT NULL").select("url", F.lit(0).alias("variant"))
    d = load(spark, sf, "documents").where("url IS NOT NULL").select("url", F.lit(1).alias("variant"))
    return v.unionByName(d).groupBy("url").agg(F.min("variant").alias("v")).select("url", F.when(F.col("v") == 0, "item").otherwise("document").alias("first_seen"))


@query(f"WITH p AS (SELECT item_id AS id, max(collected_at) AS seen, count(*) AS snapshots FROM engagement_snapshots GROUP BY item_id) SELECT i.id, coalesce(p.seen, i.fetched_at) AS seen, coalesce(p.snapshots, 0) AS snapshots FROM {ITEMS} i LEFT JOIN p USING (id)")
def patch_join(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched values back onto the raw rows; the raw ones stay where nothing is known."""
    p = load(spark, sf, "engagement_snapshots").groupBy(F.col("item_id").alias("id")).agg(F.max("collected_at").alias("s"), F.count("*").alias("c"))
    return items(spark, sf, "fetched_at").join(p, "id", "left").select("id", F.coalesce("s", "fetched_at").alias("seen"), F.coalesce("c", F.lit(0)).alias("snapshots"))
