"""Schemaless collector payloads: declared paths, fallbacks, a title cap and a reject channel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import clean_markup, human_count, parse_when

TITLE_CAP = 300


@dataclass(frozen=True)
class SourceSpec:
    """One endpoint as data: where its rows are and which paths hold which field, first hit wins."""

    key: str
    kind: str
    rows: str
    title: tuple[str, ...] = ("title", "name")
    url: tuple[str, ...] = ("url", "link", "html_url")
    date: tuple[str, ...] = ("date", "published_at", "created_at", "pubDate")
    author: tuple[str, ...] = ("author", "user.login", "user.name")
    body: tuple[str, ...] = ("content", "body", "summary", "description")
    metrics: dict[str, str] = field(default_factory=dict)
    url_prefix: str = ""


def first_path(obj: Column, paths: tuple[str, ...]) -> Column:
    """The first non-blank value among dotted paths of a JSON object given as text."""
    got = [F.get_json_object(obj, "$." + p) for p in paths]
    return F.coalesce(*[F.when(F.trim(g) != "", g) for g in got], F.lit(None).cast("string"))


def parse(payloads: DataFrame, spec: SourceSpec, now: Column, body_col: str = "value") -> DataFrame:
    """(source, kind, title, url, author, text, published_at, metrics, problem): rows of raw JSON payloads.

    ``problem`` names why a row is unusable (no rows, no title, no url); such rows stay, so that a caller can route them.
    A metric that is missing is null, never 0.
    """
    p = payloads.select(F.col(body_col).alias("raw"))
    rows = F.from_json(F.get_json_object("raw", "$." + spec.rows) if spec.rows else F.col("raw"), "array<string>")
    r = p.withColumn("rows", rows).select("raw", F.explode_outer("rows").alias("o"))
    url = first_path(F.col("o"), spec.url)
    if spec.url_prefix:
        url = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit(spec.url_prefix), url))
    out = r.select(
        F.lit(spec.key).alias("source"), F.lit(spec.kind).alias("kind"),
        F.substring(clean_markup(first_path(F.col("o"), spec.title)), 1, TITLE_CAP).alias("title"), url.alias("url"),
        first_path(F.col("o"), spec.author).alias("author"), clean_markup(first_path(F.col("o"), spec.body)).alias("text"),
        parse_when(first_path(F.col("o"), spec.date), now).alias("published_at"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in spec.metrics]), F.array(*[human_count(F.get_json_object("o", "$." + v)) for v in spec.metrics.values()])).alias("metrics") if spec.metrics else F.lit(None).cast("map<string,bigint>").alias("metrics"),
        F.col("o"),
    )
    problem = F.when(F.col("o").isNull(), "no_rows").when(F.coalesce(F.col("title"), F.lit("")) == "", "no_title").when(F.coalesce(F.col("url"), F.lit("")) == "", "no_url")
    return out.withColumn("problem", problem).drop("o")


def read(spark: SparkSession, path: str, spec: SourceSpec, now: Column) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True), spec, now)


def keep_mentioning(rows: DataFrame, phrase: str) -> DataFrame:
    """Rows whose title or text holds every word of a phrase; for a run of Han characters half of its bigrams."""
    blob = F.lower(F.concat_ws(" ", "title", "text"))
    cond = F.lit(True)
    for w in phrase.lower().split():
        if len(w) >= 3 and all("一" <= c <= "鿿" for c in w):
            grams = [w[i : i + 2] for i in range(len(w) - 1)]
            hits = sum((blob.contains(g).cast("int") for g in grams[1:]), blob.contains(grams[0]).cast("int"))
            cond = cond & (hits * 2 >= len(grams))
        else:
            cond = cond & blob.contains(w)
    return rows.where(cond)


def date_windows(spark: SparkSession, since: str, until: str, days: int) -> DataFrame:
    """(start, end): contiguous, non-overlapping windows, newest first."""
    d = spark.sql(f"SELECT explode(sequence(DATE'{since}', DATE'{until}' - INTERVAL 1 DAY, INTERVAL {days} DAY)) AS start")
    return d.select("start", F.least(F.date_add("start", days), F.lit(until).cast("date")).alias("end")).orderBy(F.desc("start"))
