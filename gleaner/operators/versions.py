"""Content-addressed versions and observations of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version_rows(df: DataFrame, identity: str, fields: list[str], observed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, versions, observations): ids are hashes of identity and content, so replays add nothing."""
    body = F.concat_ws(chr(0), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    r = df.withColumn("object_id", F.substring(F.sha1(F.concat(F.lit("evidence" + chr(0)), F.col(identity))), 1, 16)).withColumn("version_id", F.sha2(F.concat_ws(chr(0), F.col(identity), body), 256))
    objects = r.groupBy("object_id").agg(F.min(identity).alias("identity"), F.min(observed).alias("first_seen"))
    versions = r.groupBy("version_id", "object_id").agg(F.min(observed).alias("first_seen"), F.count("*").alias("sightings"))
    observations = r.select("version_id", F.col(observed).alias("observed_at")).distinct()
    return objects, versions, observations


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, the first of each key by all columns (append-only, first id wins)."""
    fresh = incoming.join(existing.select(key), key, "left_anti")
    rest = [c for c in incoming.columns if c != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*") if rest else fresh.distinct()
