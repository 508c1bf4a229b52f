"""Queries of trust, claims, merging, evaluation, windows and versions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import evaluate, frontier, merge, trust, versions
from gleaner.plans.text_queries import ITEMS, items, load

QUERIES: dict = {}
ORACLES: dict = {}
NOW = "2025-09-15 00:00:00"
# fixed values: venues whose host is not the publisher (the author is)
PLATFORMS = [
    "github.com", "gitlab.com", "gitee.com", "bitbucket.org", "npmjs.com", "pypi.org", "crates.io", "hub.docker.com", "libraries.io",
    "arxiv.org", "doi.org", "openreview.net", "aclanthology.org", "semanticscholar.org", "openalex.org", "paperswithcode.com",
    "stackoverflow.com", "stackexchange.com", "ai.stackexchange.com", "serverfault.com", "superuser.com", "askubuntu.com",
    "dev.to", "medium.com", "substack.com", "hashnode.com", "blogspot.com", "wordpress.com", "tumblr.com", "ghost.io", "beehiiv.com",
    "zhihu.com", "wukong.com", "zhidao.baidu.com", "youtube.com", "youtu.be", "vimeo.com", "twitch.tv", "bilibili.com", "b23.tv", "douyin.com", "kuaishou.com",
    "xiaohongshu.com", "xhscdn.com", "weibo.com", "s.weibo.com", "twitter.com", "x.com", "threads.net", "tiktok.com", "reddit.com", "news.ycombinator.com", "lobste.rs",
    "tieba.baidu.com", "douban.com", "hupu.com", "smzdm.com", "producthunt.com", "juejin.cn", "blog.csdn.net", "csdn.net", "bbs.hupu.com", "post.smzdm.com", "search.bilibili.com",
    "sspai.com", "oschina.net", "infoq.cn", "news.smol.ai", "share.transistor.fm", "podcastindex.org", "buzzsprout.com", "libsyn.com", "anchor.fm", "simplecast.com", "v2ex.com", "t.me",
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


# ---------------------------------------------------------------- trust
@query(rf"""SELECT id, round(least(1.0, (CAST(regexp_matches(coalesce(content, ''), '[A-Za-z][A-Za-z0-9._+-]{{2,}}') AS INT) + CAST(regexp_matches(coalesce(content, ''), '[0-9]|亿|万|千亿|美元|美金|元|人民币|%') AS INT)
 + CAST(regexp_matches(coalesce(content, ''), '(?i)https?://|www\.|\.com|\.org|\.cn') AS INT) + CAST(regexp_matches(coalesce(content, ''), '\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b') AS INT)
 + CAST(regexp_matches(coalesce(content, ''), '[\x{{3400}}-\x{{9fff}}]') AND length(content) > 40 AS INT)) / 3.0), 6) AS entity FROM {ITEMS}""")
def entity_checkable(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf, "content").select("id", F.round(trust.entity_checkable(F.col("content")), 6).alias("entity"))


_FRESH = f"(CASE WHEN published_at IS NULL THEN 0.5 ELSE pow(0.5, greatest(epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(published_at), 0) / 86400e6 / 90.0) END)"


@query(f"SELECT id, round({_FRESH}, 6) AS freshness FROM {ITEMS}")
def freshness_half_life(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf, "published_at").select("id", F.round(trust.freshness(F.col("published_at"), now()), 6).alias("freshness"))


@query(f"""SELECT id, round(1 / (1 + exp(-(-1.20 + 1.10 * coalesce(trust_features.prior, 0.5) + 0.45 * CASE WHEN trim(coalesce(author, '')) <> '' THEN 0.5 ELSE 0.4 END + 0.55 * coalesce(trust_features.cross_support, 0)
 + 0.60 * coalesce(trust_features.entity_checkable, 0) + 0.35 * {_FRESH} + 0.80 * coalesce(trust_features.provenance, 0.8) - 0.90 * coalesce(trust_features.template, 0)))), 6) AS score FROM {ITEMS}""")
def trust_logistic(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "trust_features", "author", "published_at")
    f = lambda n, z: F.coalesce(F.col(f"trust_features.{n}"), F.lit(z))
    author = F.when(F.trim(F.coalesce("author", F.lit(""))) != "", 0.5).otherwise(0.4)
    s = trust.score(f("prior", 0.5), author, f("cross_support", 0.0), f("entity_checkable", 0.0), trust.freshness(F.col("published_at"), now()), f("provenance", 0.8), f("template", 0.0))
    return d.select("id", F.round(s, 6).alias("score"))


@query(rf"""WITH h AS (SELECT id, author, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1), '^www\.', '') AS host FROM {ITEMS})
SELECT id, CASE WHEN coalesce(host, '') <> '' AND host NOT IN ({", ".join(f"'{p}'" for p in PLATFORMS)}) THEN host WHEN trim(coalesce(author, '')) <> '' THEN lower(trim(author)) END AS publisher_key FROM h""")
def publisher_of_url(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "author", "url")
    return d.select("id", trust.publisher_of(F.col("author"), F.lit(None).cast("string"), F.col("url"), PLATFORMS).alias("publisher_key"))


@query(r"""WITH u AS (SELECT doc_id, url, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS a, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN lower(s) || '://' || lower(a) || p || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END END AS canonical
FROM (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|spm=|gclid=|fbclid=)'))) AS k FROM u)""")
def canonical_url_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.canonical_url(F.col("url")).alias("canonical"))


@query(r"""WITH u AS (SELECT doc_id, url, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS a, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM documents WHERE url IS NOT NULL),
k AS (SELECT doc_id, concat_ws('|', lower(s), CASE WHEN lower(s) = 'https' THEN regexp_replace(lower(a), ':443$', '') WHEN lower(s) = 'http' THEN regexp_replace(lower(a), ':80$', '') ELSE lower(a) END, regexp_replace(p, '/+$', ''), array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|spm=|gclid=|fbclid=)')), '&')) AS url_key FROM u)
SELECT url_key, min(doc_id) AS first_doc, count(*) AS n FROM k GROUP BY url_key""")
def url_dedup_key(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").where("url IS NOT NULL").select("doc_id", T.dedup_key(F.col("url")).alias("url_key"))
    return d.groupBy("url_key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


# ---------------------------------------------------------------- claims and independence: a publication day is a claim, the items of the day its evidence
def _votes(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "published_at", "cluster_id", "publisher", "source_type", "trust")
    return d.select(F.to_date("published_at").alias("claim"), F.col("id").alias("item_id"), F.col("cluster_id").alias("cluster"), "publisher", "source_type", "trust")


_VOTES = f"""v0 AS (SELECT CAST(published_at AS DATE) AS claim, id AS item_id, coalesce(cluster_id, id) AS cluster, publisher, source_type, coalesce(trust, 0.5) AS trust FROM {ITEMS}),
cv AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY claim, cluster ORDER BY trust DESC, publisher DESC NULLS LAST, source_type DESC, item_id DESC) = 1),
dv AS (SELECT * FROM cv WHERE publisher IS NOT NULL QUALIFY row_number() OVER (PARTITION BY claim, source_type, publisher ORDER BY trust DESC, item_id) = 1),
ds AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY claim, source_type ORDER BY trust DESC, publisher) = 1 THEN 1.0 ELSE 0.5 END AS d FROM dv),
nor AS (SELECT claim, 1 - product(1 - greatest(0.0, least(1.0, trust)) * d) AS confidence, count(DISTINCT source_type) AS families, count(*) AS publishers FROM ds GROUP BY claim)"""


@query("WITH " + _VOTES + " SELECT claim, cluster, round(trust, 6) AS trust, publisher, source_type, item_id FROM cv")
def cluster_collapse_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return trust.collapse_votes(_votes(spark, sf), "claim").withColumn("trust", F.round("trust", 6))


@query("WITH " + _VOTES + " SELECT claim, round(confidence, 6) AS confidence, families, publishers FROM nor")
def noisy_or(spark: SparkSession, sf: str) -> DataFrame:
    return trust.noisy_or(trust.collapse_votes(_votes(spark, sf), "claim"), "claim").withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT CAST(published_at AS DATE) AS claim, count(DISTINCT (source_type, publisher)) AS publishers, count(DISTINCT coalesce(cluster_id, id)) AS old_count FROM (SELECT * FROM {ITEMS} WHERE publisher IS NOT NULL) GROUP BY claim")
def distinct_publishers(spark: SparkSession, sf: str) -> DataFrame:
    v = _votes(spark, sf).where("publisher IS NOT NULL")
    return v.groupBy("claim").agg(F.countDistinct("source_type", "publisher").alias("publishers"), F.countDistinct(F.coalesce("cluster", "item_id")).alias("old_count"))


@query("WITH " + _VOTES + """, al AS (SELECT DISTINCT claim FROM v0), pr AS (SELECT claim, max(p.prior) AS prior FROM dv JOIN publishers p USING (publisher) GROUP BY claim)
SELECT claim, round(coalesce(confidence, 0), 6) AS confidence, coalesce(families, 0) AS families, coalesce(publishers, 0) AS publishers,
CASE WHEN coalesce(confidence, 0) >= 0.55 AND (families >= 2 OR (families = 1 AND publishers >= 3 AND prior >= 0.40)) THEN 'supported' ELSE 'unsupported' END AS verdict,
CASE WHEN families IS NULL THEN 'no_identified_publisher' WHEN publishers = 1 THEN 'single_publisher' ELSE '' END AS reason FROM al LEFT JOIN nor USING (claim) LEFT JOIN pr USING (claim)""")
def independence_recompute(spark: SparkSession, sf: str) -> DataFrame:
    v = _votes(spark, sf)
    c = trust.collapse_votes(v, "claim")
    n = trust.noisy_or(c, "claim")
    prior = c.join(F.broadcast(load(spark, sf, "publishers").select("publisher", "prior")), "publisher").groupBy("claim").agg(F.max("prior").alias("prior"))  # a fixed dimension of 72 rows
    a = v.select("claim").distinct().join(n, "claim", "left").join(prior, "claim", "left")
    reason = F.when(F.col("families").isNull(), "no_identified_publisher").when(F.col("publishers") == 1, "single_publisher").otherwise("")
    conf = F.coalesce("confidence", F.lit(0.0))
    return a.select("claim", F.round(conf, 6).alias("confidence"), F.coalesce("families", F.lit(0)).alias("families"), F.coalesce("publishers", F.lit(0)).alias("publishers"), trust.verdict(conf, F.col("families"), F.col("publishers"), F.col("prior")).alias("verdict"), reason.alias("reason"))


@query("SELECT l_orderkey, l_linenumber, rn FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def topk_evidence_per_claim(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("bigint").alias("rn")).where("rn <= 3")


def sibling_counts(e: DataFrame) -> DataFrame:
    """(claim, siblings): with how many other claims each claim shares an item; e: (claim, item). A pair is shuffled once, not in both orders."""
    e = e.where("claim IS NOT NULL AND item IS NOT NULL").distinct()
    pairs = e.join(e.select(F.col("claim").alias("other"), "item"), "item").where("claim < other").select("claim", "other").distinct()
    return pairs.select(F.explode(F.array("claim", "other")).alias("claim")).groupBy("claim").agg(F.count("*").alias("siblings"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS claim, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT claim, count(DISTINCT other) AS siblings FROM (SELECT a.claim, b.claim AS other FROM e a JOIN e b ON a.item = b.item AND a.claim <> b.claim) GROUP BY claim""")
def sibling_claims_all(spark: SparkSession, sf: str) -> DataFrame:
    """With how many other claims each shares evidence, over the evidence of all orders."""
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("claim"))
    return sibling_counts(load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("claim", "item"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200")
def triage_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'R' AND l_partkey <> l_suppkey")
def contradiction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_partkey <> l_suppkey")
    return d.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


# ---------------------------------------------------------------- merging and digests
@query("""WITH d AS (SELECT * FROM documents WHERE url IS NOT NULL)
SELECT url, arg_max(doc_id, (length(text), -doc_id)) AS richest_doc, arg_min(source, doc_id) FILTER (WHERE trim(source) <> '') AS source, coalesce(list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL)), []) AS langs, count(*) AS n FROM d GROUP BY url""")
def richest_content_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").where("url IS NOT NULL")
    return d.groupBy("url").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("richest_doc"), F.min_by("source", F.when(F.trim("source") != "", F.col("doc_id"))).alias("source"), F.array_sort(F.collect_set("lang")).alias("langs"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand, p_retailprice, place FROM (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS place FROM part) WHERE place <= 5 ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 60")
def digest_quota(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return merge.group_quota(d, "p_brand", "p_retailprice", "p_partkey", 5, 60).withColumn("place", F.col("place").cast("bigint"))


@query("WITH t AS (SELECT p_brand, avg(p_retailprice) AS threshold FROM part GROUP BY p_brand) SELECT p_partkey FROM part LEFT JOIN t USING (p_brand) WHERE threshold IS NULL OR coalesce(p_retailprice >= threshold, false)")
def digest_threshold_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "part")
    t = d.groupBy("p_brand").agg(F.avg("p_retailprice").alias("threshold"))
    return d.join(t, "p_brand", "left").where(F.col("threshold").isNull() | F.coalesce(F.col("p_retailprice") >= F.col("threshold"), F.lit(False))).select("p_partkey")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) ORDER BY rn, f, doc_id LIMIT 100")
def host_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return merge.round_robin(load(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 100).select("doc_id", "source")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) > 4 AS late FROM documents) ORDER BY late, doc_id LIMIT 400")
def per_host_cap_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return merge.capped_with_backfill(load(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 4, 400).select("doc_id", "source")


@query("SELECT CASE WHEN o_totalprice IS NULL THEN 'unscored' WHEN o_totalprice < 50000 THEN '0' WHEN o_totalprice < 150000 THEN '1' WHEN o_totalprice < 250000 THEN '2' WHEN o_totalprice < 350000 THEN '3' ELSE '4' END AS bucket, count(*) AS n FROM orders GROUP BY bucket")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    b = F.when(p.isNull(), "unscored").when(p < 50000, "0").when(p < 150000, "1").when(p < 250000, "2").when(p < 350000, "3").otherwise("4")
    return load(spark, sf, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return merge.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_version_window(spark: SparkSession, sf: str) -> DataFrame:
    return merge.latest(load(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("WITH e AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS nw FROM events), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e) SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run")
def run_length_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return merge.run_lengths(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("WITH m AS (SELECT quantile_disc(ts, 0.5) AS m FROM events), b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events, m WHERE ts < m GROUP BY user_id), a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events, m WHERE ts >= m GROUP BY user_id) SELECT coalesce(a.user_id, b.user_id) AS user_id, b.s AS old, a.s AS new FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.s IS DISTINCT FROM b.s")
def state_delta_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    mid = F.broadcast(e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(ts::timestamp_ltz))").alias("m")))
    x = e.join(mid).withColumn("late", F.unix_micros(F.col("ts").cast("timestamp_ltz")) >= F.col("m"))
    last = lambda d: d.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"))
    return merge.state_delta(last(x.where("NOT late")), last(x.where("late")), "user_id", "s")


@query("SELECT (SELECT count(DISTINCT url) FROM documents) AS documents_urls, (SELECT count(DISTINCT url) FROM corpus_items) AS item_urls, (SELECT count(*) FROM (SELECT url FROM documents WHERE url IS NOT NULL EXCEPT SELECT url FROM corpus_items)) AS only_documents, (SELECT count(*) FROM (SELECT source FROM documents INTERSECT SELECT publisher FROM corpus_items)) AS shared_hosts")
def coverage_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    d, i = load(spark, sf, "documents"), load(spark, sf, "corpus_items")
    a, b = d.agg(F.countDistinct("url").alias("documents_urls")), i.agg(F.countDistinct("url").alias("item_urls"))
    c = d.where("url IS NOT NULL").select("url").subtract(i.select("url")).agg(F.count("*").alias("only_documents"))
    e = d.select("source").intersect(i.select(F.col("publisher").alias("source"))).agg(F.count("*").alias("shared_hosts"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(e))  # single rows


# ---------------------------------------------------------------- snapshots, events and windows
@query("WITH u AS (SELECT DISTINCT item_id, platform, collected_at, source_run, metrics FROM engagement_snapshots), v AS (SELECT *, map_extract(metrics, 'likes')[1] AS likes, map_extract(metrics, 'views')[1] AS views FROM u) SELECT item_id, platform, max(collected_at) AS collected_at, count(*) AS snapshots, arg_max(likes, (collected_at, likes)) FILTER (WHERE likes IS NOT NULL) AS likes, arg_max(views, (collected_at, views)) FILTER (WHERE views IS NOT NULL) AS views FROM v GROUP BY item_id, platform")
def latest_snapshot_max_by(spark: SparkSession, sf: str) -> DataFrame:
    """When each item was last seen, how often, and the last known value of each metric."""
    get = lambda k: F.try_element_at("metrics", F.lit(k)).alias(k)
    e = load(spark, sf, "engagement_snapshots").withColumn("m", F.array_sort(F.map_entries("metrics"))).select("item_id", "platform", "collected_at", "source_run", "m", get("likes"), get("views")).distinct()
    last = lambda k: F.max_by(k, F.when(F.col(k).isNotNull(), F.struct("collected_at", k))).alias(k)
    return e.groupBy("item_id", "platform").agg(F.max("collected_at").alias("collected_at"), F.count("*").alias("snapshots"), last("likes"), last("views"))


@query("WITH e AS (SELECT item_id, platform, collected_at, unnest(map_entries(metrics)) AS m FROM engagement_snapshots) SELECT platform, m.key AS metric, count(m.value) AS known, CAST(sum(m.value) AS BIGINT) AS total FROM e GROUP BY platform, m.key")
def metric_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A missing metric is null, never 0."""
    e = load(spark, sf, "engagement_snapshots").select("platform", F.explode("metrics").alias("metric", "value"))
    return e.groupBy("platform", "metric").agg(F.count("value").alias("known"), F.sum("value").alias("total"))


@query("WITH u AS (SELECT DISTINCT item_id, platform, collected_at FROM engagement_snapshots), g AS (SELECT *, lag(collected_at) OVER (PARTITION BY item_id, platform ORDER BY collected_at) AS prev FROM u) SELECT item_id, platform, collected_at, CAST((epoch_us(collected_at) - epoch_us(prev)) // 1000000 AS BIGINT) AS gap_seconds FROM g")
def snapshot_gaps(spark: SparkSession, sf: str) -> DataFrame:
    u = load(spark, sf, "engagement_snapshots").select("item_id", "platform", "collected_at").distinct()
    w = Window.partitionBy("item_id", "platform").orderBy("collected_at")
    return u.withColumn("gap_seconds", F.floor((F.unix_micros("collected_at") - F.unix_micros(F.lag("collected_at").over(w))) / 1000000).cast("bigint"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY start, event_type")
def snapshot_tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("WITH s AS (SELECT event_type, ts, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) SELECT start, event_type, count(*) AS n FROM s GROUP BY start, event_type")
def snapshot_sliding_window(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last_event, count(*) AS n FROM s GROUP BY user_id, k")
def snapshot_session_window(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last_event"), F.count("*").alias("n")).select("user_id", "start", "last_event", "n")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(DISTINCT json_extract_string(props, '$.k')) AS k_distinct FROM events GROUP BY event_type")
def json_metrics_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("k").try_cast("bigint")).alias("k_sum"), F.countDistinct("k").alias("k_distinct"))


@query(f"SELECT time_basis, count(*) AS n, count(*) FILTER (WHERE json_valid(metadata)) AS valid_json FROM {ITEMS} GROUP BY time_basis")
def metadata_validity(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "time_basis", "metadata")
    return d.groupBy("time_basis").agg(F.count("*").alias("n"), F.count(F.expr("try_parse_json(metadata)")).alias("valid_json"))


# ---------------------------------------------------------------- sections, citations, versions
@query(f"""WITH s AS (SELECT id, unnest(sections) AS s FROM {ITEMS}) SELECT id, count(*) AS sections, count(*) FILTER (WHERE s.tier = 'primary' AND s.asserted AND trim(s.text) <> '') AS claimable, CAST(coalesce(sum(length(s.text)) FILTER (WHERE s.tier = 'primary' AND s.asserted AND trim(s.text) <> ''), 0) AS BIGINT) AS claimable_chars FROM s GROUP BY id""")
def section_tiering(spark: SparkSession, sf: str) -> DataFrame:
    ok = (F.col("s.tier") == "primary") & F.col("s.asserted") & (F.trim(F.col("s.text")) != "")
    d = items(spark, sf, "sections").select("id", F.explode("sections").alias("s"))
    return d.groupBy("id").agg(F.count("*").alias("sections"), F.count_if(ok).alias("claimable"), F.coalesce(F.sum(F.when(ok, F.length("s.text"))), F.lit(0)).cast("bigint").alias("claimable_chars"))


@query("WITH f AS (SELECT c.item_id, c.author, min(c.created_at) AS first_at FROM comments c WHERE author IS NOT NULL GROUP BY c.item_id, c.author) SELECT item_id, author, dense_rank() OVER (PARTITION BY item_id ORDER BY first_at, author) AS number FROM f")
def citation_numbering(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "comments").where("author IS NOT NULL").groupBy("item_id", "author").agg(F.min("created_at").alias("first_at"))
    return f.select("item_id", "author", F.dense_rank().over(Window.partitionBy("item_id").orderBy("first_at", "author")).cast("bigint").alias("number"))


@query("WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://([a-z0-9.-]+)/', 1)) AS host FROM documents) SELECT host, count(*) AS links, count(DISTINCT doc_id) AS documents, host IN (SELECT publisher FROM publishers) AS resolved FROM c GROUP BY host")
def citation_audit(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("https?://([a-z0-9.-]+)/"), F.lit(1))).alias("host"))
    known = load(spark, sf, "publishers").select(F.col("publisher").alias("host")).where("host IS NOT NULL").distinct().withColumn("known", F.lit(True))
    g = c.groupBy("host").agg(F.count("*").alias("links"), F.countDistinct("doc_id").alias("documents"))
    return g.join(F.broadcast(known), "host", "left").select("host", "links", "documents", F.coalesce("known", F.lit(False)).alias("resolved"))  # a fixed dimension


@query("WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '### \\[([^\\]]+)\\]\\((https?://[^)]+)\\)', 1)) AS title, unnest(regexp_extract_all(text, '### \\[([^\\]]+)\\]\\((https?://[^)]+)\\)', 2)) AS url FROM documents) SELECT doc_id, title, url, count(*) AS n FROM h GROUP BY ALL")
def digest_headings_links(spark: SparkSession, sf: str) -> DataFrame:
    p = F.lit("### \\[([^\\]]+)\\]\\((https?://[^)]+)\\)")
    d = load(spark, sf, "documents").where(F.col("text").contains("### [")).select("doc_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", p, F.lit(1)).alias("title"), F.regexp_extract_all("text", p, F.lit(2)).alias("url"))).alias("h"))
    return d.select("doc_id", "h.title", "h.url").groupBy("doc_id", "title", "url").agg(F.count("*").alias("n"))


@query("SELECT sha256(url || chr(0) || coalesce(title, '') || chr(0) || coalesce(text, '')) AS version_id, substr(sha1('evidence' || chr(0) || url), 1, 16) AS object_id, min(fetched_at) AS first_seen, count(*) AS sightings FROM documents WHERE url IS NOT NULL GROUP BY ALL")
def version_ids_sha256(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").where("url IS NOT NULL").select("url", "title", "text", "fetched_at")
    return versions.version_rows(d, "url", ["title", "text"], "fetched_at")[1]


@query(f"WITH r AS (SELECT i.*, r.started_at FROM {ITEMS} i LEFT JOIN runs r ON i.run_id = r.id) SELECT run_id, count(*) AS n, min(fetched_at) AS first_item, bool_or(started_at IS NULL) AS orphan FROM r GROUP BY run_id")
def run_accounting(spark: SparkSession, sf: str) -> DataFrame:
    r = load(spark, sf, "runs").select(F.col("id").alias("rid"), "started_at")
    d = items(spark, sf, "run_id", "fetched_at").join(F.broadcast(r), F.col("run_id") == F.col("rid"), "left")  # a fixed table of 60 rows
    return d.groupBy("run_id").agg(F.count("*").alias("n"), F.min("fetched_at").alias("first_item"), F.bool_or(F.col("started_at").isNull()).alias("orphan"))


# ---------------------------------------------------------------- evaluation: suites are queries, their leading words the run
def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = items(spark, sf, "source_type", "trust", "published_at")
    w = Window.partitionBy("source_type").orderBy(F.desc_nulls_last("trust"), "id")
    runs = d.select(F.col("source_type").alias("query_id"), F.col("id").alias("doc"), F.row_number().over(w).alias("rank"))
    t = F.coalesce("trust", F.lit(0.0))
    grades = d.select(F.col("source_type").alias("query_id"), F.col("id").alias("doc"), F.when(F.dayofmonth("published_at") % 5 == 0, 2).when(F.dayofmonth("published_at") % 3 == 0, 1).alias("grade")).where("grade > 0")
    return runs.where("rank <= 10"), grades


_IR = f"""runs AS (SELECT source_type AS query_id, id AS doc, row_number() OVER (PARTITION BY source_type ORDER BY trust DESC NULLS LAST, id) AS rank FROM {ITEMS} QUALIFY rank <= 10),
q AS (SELECT * FROM (SELECT source_type AS query_id, id AS doc, CASE WHEN day(published_at) % 5 = 0 THEN 2 WHEN day(published_at) % 3 = 0 THEN 1 END AS grade FROM {ITEMS}) WHERE grade > 0),
g AS (SELECT q.*, r.rank, row_number() OVER (PARTITION BY q.query_id ORDER BY grade DESC, q.doc) AS best FROM q LEFT JOIN runs r ON q.query_id = r.query_id AND q.doc = r.doc)"""


@query("WITH " + _IR + " SELECT query_id, round(count(rank) / count(*), 6) AS recall, round(count(rank) / 10, 6) AS precision, round(coalesce(1 / min(rank), 0), 6) AS rr, round(coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (WHERE rank IS NOT NULL), 0) / sum((pow(2, grade) - 1) / log2(best + 1)) FILTER (WHERE best <= 10), 6) AS ndcg FROM g GROUP BY query_id")
def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.ir_metrics(*_runs(spark, sf), 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "ndcg")])


_CONF = "p AS (SELECT CASE l_returnflag WHEN 'R' THEN 'contested' WHEN 'A' THEN 'supported' ELSE 'unsupported' END AS human, CASE WHEN l_linestatus = 'O' THEN 'unsupported' WHEN l_quantity > 30 THEN 'contested' ELSE 'supported' END AS machine, l_quantity FROM lineitem)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    h = F.when(F.col("l_returnflag") == "R", "contested").when(F.col("l_returnflag") == "A", "supported").otherwise("unsupported")
    m = F.when(F.col("l_linestatus") == "O", "unsupported").when(F.col("l_quantity") > 30, "contested").otherwise("supported")
    return load(spark, sf, "lineitem").select(h.alias("human"), m.alias("machine"), "l_quantity")


@query("WITH " + _CONF + ", l AS (SELECT unnest(['supported', 'unsupported', 'contested']) AS label), s AS (SELECT label, count(*) FILTER (WHERE human = label AND machine = label) AS tp, count(*) FILTER (WHERE human <> label AND machine = label) AS fp, count(*) FILTER (WHERE human = label AND machine <> label) AS fn FROM p, l GROUP BY label), x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM s) SELECT label, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM x")
def confusion_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    c = evaluate.confusion(_labelled(spark, sf), ["supported", "unsupported", "contested"])
    return c.select("label", *[F.col(x).cast("bigint").alias(x) for x in ("tp", "fp", "fn")], *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("WITH " + _CONF + " SELECT CASE WHEN l_quantity <= 10 THEN '1' WHEN l_quantity <= 20 THEN '2' ELSE '3+' END AS bucket, count(*) AS n, round(avg(CASE WHEN human = machine THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM p GROUP BY bucket")
def agreement_buckets(spark: SparkSession, sf: str) -> DataFrame:
    b = F.when(F.col("l_quantity") <= 10, "1").when(F.col("l_quantity") <= 20, "2").otherwise("3+")
    return _labelled(spark, sf).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("human") == F.col("machine")).cast("double")), 6).alias("agreement"))


@query(f"WITH p AS (SELECT greatest(0, least(100, CAST(floor(trust * 100 + 1e-9) AS INT))) AS b, day(published_at) % 2 = 0 AS pos FROM {ITEMS} WHERE trust IS NOT NULL), g AS (SELECT unnest(range(1, 100)) AS t), c AS (SELECT t, count(*) FILTER (WHERE b >= t AND pos) AS tp, count(*) FILTER (WHERE b >= t) AS f FROM g, p GROUP BY t), n AS (SELECT count(*) FILTER (WHERE pos) AS pos FROM p) SELECT CAST(t / 100 AS DOUBLE) AS threshold, round(2 * tp / (f + pos), 6) AS f1 FROM c, n ORDER BY 2 * tp / (f + pos) DESC, t LIMIT 1")
def roc_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    p = items(spark, sf, "trust", "published_at").where("trust IS NOT NULL").select(F.col("trust").alias("score"), (F.dayofmonth("published_at") % 2 == 0).alias("positive"))
    return evaluate.threshold_grid(p).select("threshold", F.round("f1", 6).alias("f1"))


@query(f"WITH s AS (SELECT source_type, id, CASE WHEN trust IS NULL THEN NULL ELSE 4 * trust END AS a, length(coalesce(content, '')) AS n, published_at FROM {ITEMS}) SELECT id, round(least(1.0, coalesce(least(a / 4, 1.0), 0.5) + CASE WHEN published_at > TIMESTAMPTZ '{NOW}+00' THEN 0 WHEN published_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 1 DAY THEN 0.12 WHEN published_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 3 DAY THEN 0.06 WHEN published_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 7 DAY THEN 0.02 ELSE 0 END + CASE WHEN n >= 400 THEN 0.1 ELSE 0 END), 6) AS score FROM s")
def layer_score_merge(spark: SparkSession, sf: str) -> DataFrame:
    p, n = F.col("published_at"), now()
    fresh = F.when(p > n, 0.0).when(p >= n - F.expr("INTERVAL 1 DAY"), 0.12).when(p >= n - F.expr("INTERVAL 3 DAY"), 0.06).when(p >= n - F.expr("INTERVAL 7 DAY"), 0.02).otherwise(0.0)
    s = F.least(F.lit(1.0), F.coalesce(F.least(F.col("trust"), F.lit(1.0)), F.lit(0.5)) + fresh + F.when(F.length(F.coalesce("content", F.lit(""))) >= 400, 0.1).otherwise(0.0))
    return items(spark, sf, "trust", "content", "published_at").select("id", F.round(s, 6).alias("score"))


def _frontier_sql(per_round: int, rounds: int) -> str:
    """The crawl written out round by round."""
    c = [
        "pages AS (SELECT url, max(length(text)) AS priority FROM documents WHERE url IS NOT NULL GROUP BY url)", "home AS (SELECT source, min(url) AS dst FROM documents WHERE url IS NOT NULL GROUP BY source)",
        "links AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT url AS src, unnest(regexp_extract_all(text, 'https?://([a-z0-9.-]+)/', 1)) AS source FROM documents WHERE url IS NOT NULL) JOIN home USING (source))", "o0 AS (SELECT DISTINCT dst AS url, 0 AS depth FROM home)", "v0 AS (SELECT url, depth FROM o0 WHERE false)",
    ]
    for k in range(1, rounds + 1):
        c.append(f"r{k} AS MATERIALIZED (SELECT * FROM o{k - 1} WHERE url NOT IN (SELECT url FROM v{k - 1}))")
        c.append(f"t{k} AS MATERIALIZED (SELECT r{k}.url, depth FROM r{k} JOIN pages ON pages.url = r{k}.url ORDER BY priority DESC, r{k}.url LIMIT {per_round})")
        c.append(f"v{k} AS MATERIALIZED (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM t{k})")
        c.append(f"o{k} AS MATERIALIZED (SELECT url, min(depth) AS depth FROM (SELECT * FROM r{k} WHERE url NOT IN (SELECT url FROM t{k}) UNION ALL SELECT dst, depth + 1 FROM t{k} JOIN links ON url = src) GROUP BY url)")
    return f"WITH {', '.join(c)} SELECT url, depth FROM v{rounds}"


@query(_frontier_sql(40, 4))
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Best-first crawl over the documents' own links: a url's priority is its text length, links are those between publishers of digests."""
    d = load(spark, sf, "documents").where("url IS NOT NULL").select("url", "source", "text")
    pages = d.groupBy("url").agg(F.max(F.length("text")).alias("priority"))
    home = d.groupBy("source").agg(F.min("url").alias("dst"))
    links = d.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("text", F.lit("https?://([a-z0-9.-]+)/"), F.lit(1))).alias("source")).distinct().join(home, "source").select("src", "dst").distinct()
    return frontier.crawl(pages, links, home.select(F.col("dst").alias("url")), 40, 4)


@query(f"SELECT id FROM {ITEMS} WHERE list_has_all(string_split(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(content, '')), '[^a-z0-9]+', ' ', 'g'), ' '), ['council', 'licence'])")
def query_relevance_match(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.regexp_replace(F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))), "[^a-z0-9]+", " "), " ")
    return items(spark, sf, "title", "content").where(F.array_contains(words, "council") & F.array_contains(words, "licence")).select("id")


@query("SELECT parent_count, count(*) AS items FROM (SELECT item_id, count(DISTINCT id) AS parent_count FROM comments GROUP BY item_id) GROUP BY parent_count")
def discussion_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "comments").groupBy("item_id").agg(F.countDistinct("id").alias("parent_count")).groupBy("parent_count").agg(F.count("*").alias("items"))
