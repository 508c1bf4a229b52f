"""Writers: append-only items, idempotent snapshots, latest-wins upserts, staged runs and rendered text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.merge import latest
from gleaner.operators.versions import append_new
from gleaner.session import exists


def append_items(spark: SparkSession, path: str, incoming: DataFrame, key: str = "id") -> None:
    """Only ids that are not stored yet are written; the first version of an id stays for good."""
    old = spark.read.parquet(path) if exists(spark, path) else incoming.limit(0)
    append_new(old, incoming, key).write.mode("append").parquet(path)


def append_snapshots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Snapshots that are new by (item_id, platform, collected_at); empty metrics are dropped."""
    keys = ["item_id", "platform", "collected_at"]
    fresh = incoming.where(F.size("metrics") > 0).join(existing.select(*keys), keys, "left_anti")
    m = [c for c in incoming.columns if c not in keys and c != "metrics"]
    return fresh.groupBy(*keys).agg(F.min_by(F.struct("metrics", *m), F.xxhash64(F.map_entries("metrics"))).alias("_r")).select(*keys, "_r.*")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key over both sides; later ties go to the incoming one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, keys, [order, "_new"]).drop("_new")


def trim_top(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).where(F.col("_r") <= k).drop("_r")


STAGES = ("raw", "scored", "filtered", "enriched")


def save_stage(df: DataFrame, run_dir: str, stage: str) -> None:
    """Writes a stage of a run; later stages become invalid and go."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{run_dir}/{stage}")
    p = spark._jvm.org.apache.hadoop.fs.Path
    for s in STAGES[STAGES.index(stage) + 1 :]:
        at = p(f"{run_dir}/{s}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fill_template(template: str, values: dict[str, str]) -> str:
    """``#{name}``, ``#{name?limit=40}`` and ``#{name?split=,}``; unknown names become empty."""

    def put(m: re.Match) -> str:
        v = str(values.get(m[1], ""))
        for opt in (m[2] or "").split("&"):
            k, _, x = opt.partition("=")
            if k == "limit" and x.isdigit():
                v = v[: int(x)]
            elif k == "split" and x:
                v = v.split(x)[0]
        return v

    return re.sub(r"#\{(\w+)(?:\?([^}]*))?\}", put, template)


def pack_paragraphs(text: str, limit: int) -> list[str]:
    """Paragraphs joined into chunks of at most ``limit`` characters; a longer paragraph is cut at the limit."""
    out: list[str] = []
    for p in text.split("\n\n"):
        while len(p) > limit:
            out.append(p[:limit])
            p = p[limit:]
        if out and len(out[-1]) + 2 + len(p) <= limit:
            out[-1] += "\n\n" + p
        elif p:
            out.append(p)
    return out


def render_digest(rows: DataFrame, title: str, most: int = 200) -> str:
    """Markdown of at most ``most`` rows (section, title, url, summary), by section."""
    got = rows.orderBy("section", "title").limit(most).collect()
    lines, last = [f"# {title}", ""], None
    for r in got:
        if r["section"] != last:
            lines += [f"## {r['section']}", ""]
            last = r["section"]
        safe = re.sub(r"([\\`*_{}\[\]<>])", r"\\\1", r["title"] or "")
        lines += [f"### [{safe}]({r['url']})" if re.match(r"https?://", r["url"] or "") else f"### {safe}", "", r["summary"] or "", ""]
    return "\n".join(lines)
