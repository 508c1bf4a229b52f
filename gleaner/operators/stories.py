"""One story from many sources: title keys, buckets of titles, merged records and their scores.

Defined cases: a title of fewer than six signs is keyed by its URL; without a
URL it stands alone; null fields fill nothing; ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: names of sites that stand behind a title, and of columns before it
SITE_SUFFIX = "(?i)[_\\-|｜\\s]*(哔哩哔哩|bilibili|知乎|微博|抖音|今日头条|新浪\\S*|搜狐\\S*|国家一类新闻网站)$"
COLUMN_PREFIX = "^(相关视频|相关阅读|查看更多|视频丨|视频｜)\\s*[-:：]\\s*"
LEAD = "^(视频|组图|图集|直播|快讯|独家|重磅)"
SIGNS = "[，。！？、；：“”‘’（）【】《》…—·,.!?;:\"'()\\[\\]<>|/\\-]"
BREAKS = "[！!？?。…—|]"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
GOOD_HOSTS = ("arxiv.org", "github.com", ".edu", ".gov", "openalex.org", "crossref.org")
KEY = 20
SHORTEST = 6
PREFIX = 8


def unescape(s: Column) -> Column:
    """Entities once; the ampersand last, so that nothing is unescaped twice."""
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def normal(title: Column) -> Column:
    """A title's content: entities once, without site suffix, column prefix, spaces, signs and markup, lower case."""
    s = F.regexp_replace(F.regexp_replace(unescape(title), SITE_SUFFIX, ""), COLUMN_PREFIX, "")
    s = F.regexp_replace(F.regexp_replace(s, "[\\s\\x{3000}_]+", ""), SIGNS, "")
    return F.lower(s)


def without_repeat(s: Column) -> Column:
    """The first half of a text whose halves are alike but for their last two characters."""
    half = F.floor(F.length(s) / 2).cast("int")
    a, b = F.substring(s, F.lit(1), half - 2), F.substring(s, half + 1, half - 2)
    return F.when((half >= SHORTEST) & (a == b), F.substring(s, F.lit(1), half)).otherwise(s)


def cluster_key(title: Column, url: Column) -> Column:
    """The first 20 signs of a title's longest segment; the URL's where titles are too short."""
    segs = F.transform(F.split(F.trim(title), BREAKS), lambda x: without_repeat(normal(x)))
    fine = F.transform(F.filter(segs, lambda x: F.length(x) >= SHORTEST), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))
    # the longest, of equal ones the first
    best = F.aggregate(fine, F.lit(None).cast("struct<n:int,x:string>"), lambda a, x: F.when(a.isNull() | (x["n"] < a["n"]), x).otherwise(a))["x"]
    whole = without_repeat(normal(F.trim(title)))
    t = F.coalesce(best, F.when(F.length(whole) >= SHORTEST, whole))
    by_url = F.when(F.length(F.coalesce(url, F.lit(""))) > 0, F.concat(F.lit("u:"), F.substring(url, 1, 64)))
    return F.coalesce(F.substring(F.regexp_replace(t, LEAD, ""), 1, KEY), by_url)


def prefix_buckets(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, bucket): the shortest key of the table, of at least eight signs, that begins a key; itself if none.

    A key meets its own prefixes, so the join is an equi-join on at most
    ``KEY - PREFIX`` candidates a key, not a comparison of all keys.
    """
    k = keys.select(key).where(F.col(key).isNotNull()).distinct()
    titles = k.where(~F.col(key).startswith("u:"))
    shorter = F.transform(F.sequence(F.lit(PREFIX), F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))
    cand = titles.where(F.length(key) >= PREFIX).select(key, F.explode(shorter).alias("bucket"))
    got = cand.join(titles.select(F.col(key).alias("bucket")), "bucket", "left_semi").groupBy(key).agg(F.min_by("bucket", F.length("bucket")).alias("bucket"))
    return k.join(got, key, "left").select(key, F.coalesce("bucket", key).alias("bucket"))


def freshness_bonus(day: Column, today: Column) -> Column:
    d = F.datediff(today, day)
    return F.when(d < 0, 0.0).when(d <= 1, 0.12).when(d <= 3, 0.06).when(d <= 7, 0.02).otherwise(0.0)


def score(authority: Column, rerank: Column, trust: Column, fresh: Column, body: Column, url: Column) -> Column:
    """The mean of what is known of authority (0 to 4), rerank (0 to 3) and trust, with bonuses, at most 1."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    known = F.filter(F.array(F.when(authority >= 0, clamp(authority / 4.0)), F.when(rerank > 0, clamp(rerank / 3.0)), F.when(trust.isNotNull(), clamp(trust))), lambda x: x.isNotNull())
    base = F.when(F.size(known) == 0, 0.5).otherwise(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    n = F.length(F.coalesce(body, F.lit("")))
    low = F.lower(F.coalesce(url, F.lit("")))
    good = F.exists(F.array(*[F.lit(h) for h in GOOD_HOSTS]), lambda h: F.contains(low, h))
    return F.least(F.lit(1.0), base + F.coalesce(fresh, F.lit(0.0)) + F.when(n >= 1000, 0.08).when(n >= 400, 0.04).otherwise(0.0) + F.when(good, 0.08).otherwise(0.0))


def merged(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    """One record per bucket of rows (id, publisher, score, body): the best scored head, the longest body, how many independent voices.

    Counts are exact and pre-aggregated; no bucket comes to one task whole.
    """
    per = rows.groupBy(bucket).agg(
        F.max_by("id", F.struct("score", "id")).alias("head"), F.max("score").alias("top"), F.count("*").alias("variants"),
        F.max(F.length(F.coalesce("body", F.lit("")))).cast("bigint").alias("body_chars"), F.countDistinct(F.when(F.length(F.trim("publisher")) > 0, F.trim("publisher"))).alias("independent"),
    )
    bonus = F.greatest(F.lit(0.0), F.least((F.col("independent") - 1) * 0.06, F.lit(0.18)))
    return per.withColumn("merged_score", F.least(F.col("top") + bonus, F.lit(1.0)))
