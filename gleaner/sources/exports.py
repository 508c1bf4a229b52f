"""User exports, journals and run shards: strict validation, reject and continue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "source_type string, title string, locator string, url string, author string, published_at string, time_basis string, metadata map<string,string>, sections array<struct<tier:string,text:string,author:string,provenance:string>>"
BATCH = "version int, batch_id string, corpus_id string, created_at string, round_id string, rows array<string>"
TIERS = ("primary", "community")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of exports ``{"items": [...]}`` with its file, place and ``problem`` (null where valid)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"items array<struct<{_ddl_struct(ITEM)}>>").alias("x"))
    rows = raw.select("file", F.posexplode_outer("x.items").alias("pos", "i")).select("file", "pos", "i.*")
    return validated(rows)


def _ddl_struct(ddl: str) -> str:
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, kind = ddl[start:k].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = k + 1
    return ",".join(out)


def validated(rows: DataFrame) -> DataFrame:
    """Adds ``item_id`` (hash of type, locator or url and title), ``when``, ``basis`` and ``problem``."""
    when = F.try_to_timestamp("published_at")
    bad_tier = F.exists(F.coalesce("sections", F.array().cast("array<struct<tier:string,text:string,author:string,provenance:string>>")), lambda s: ~s["tier"].isin(*TIERS) | s["tier"].isNull())
    problem = (
        F.when(F.col("pos").isNull(), "no_items")
        .when(F.trim(F.coalesce("source_type", F.lit(""))) == "", "no_source_type")
        .when(F.trim(F.coalesce("title", F.lit(""))) == "", "no_title")
        .when(F.coalesce("url", "locator").isNull(), "no_url_or_locator")
        .when(F.col("url").isNotNull() & ~F.col("url").rlike("(?i)^https?://[^\\s/]+"), "bad_url")
        .when(bad_tier, "bad_tier")
    )
    basis = F.when(when.isNull(), "unknown").otherwise(F.coalesce("time_basis", F.lit("published")))
    return rows.withColumn("item_id", F.concat("source_type", F.lit(":export:"), F.substring(F.sha2(F.concat_ws("\u0000", "source_type", F.coalesce("locator", "url"), "title"), 256), 1, 16))).withColumn("when", when).withColumn("basis", basis).withColumn("problem", problem)


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a directory of one-line batches, rows in replay order (created_at, batch_id, place)."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value"), F.from_json("value", BATCH).alias("b"))
    return split_batches(raw)


def split_batches(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = F.try_to_timestamp("b.created_at")
    ok = (F.col("b.version") == 1) & F.col("b.batch_id").isNotNull() & F.col("b.corpus_id").isNotNull() & at.isNotNull() & F.col("b.rows").isNotNull()
    good = raw.where(F.coalesce(ok, F.lit(False)))
    rows = good.select(at.alias("created_at"), "b.batch_id", "b.corpus_id", "b.round_id", F.posexplode("b.rows").alias("pos", "row"))
    return rows, raw.where(~F.coalesce(ok, F.lit(False))).select("file", "value")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(digest_date, title, url, summary) of markdown digests named ``*-YYYY-MM-DD.md``: linked headings and their first paragraph."""
    raw = spark.read.text(path, wholetext=True).select(F.to_date(F.regexp_extract(F.input_file_name(), "(\\d{4}-\\d{2}-\\d{2})\\.md$", 1)).alias("digest_date"), "value")
    p = F.lit("(?m)^#{2,3} \\[([^\\]]+)\\]\\(([^)]+)\\)[^\\n]*\\n+([^\\n]*)")
    z = F.arrays_zip(*[F.regexp_extract_all("value", p, F.lit(i)).alias(n) for i, n in ((1, "title"), (2, "url"), (3, "summary"))])
    d = raw.select("digest_date", F.explode(z).alias("e")).select("digest_date", "e.*")
    return d.withColumn("summary", F.when(F.col("summary").rlike("^[#<*]"), "").otherwise(F.col("summary")))
