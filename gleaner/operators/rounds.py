"""Investigation rounds: evidence attached to them, its latest state, event logs and redirects.

Defined cases: a round without an end is running; rows without a key take no
part; ties in time go to the larger batch, then to the larger id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.components import connected_components


def latest_evidence(evidence: DataFrame, observations: DataFrame, redirects: DataFrame, finished_rounds: DataFrame, extra: list | None = None) -> DataFrame:
    """(canonical_id, level, object_id, round_id, observed_at): the latest observation of each object and content level.

    evidence: (round_id, object_id, level); observations: (object_id, observed_at);
    redirects: (object_id, canonical_id); finished_rounds: (round_id). The latest
    is an aggregate with a total order, so no object's history is sorted in one task.
    """
    e = evidence.join(finished_rounds, "round_id").join(observations, "object_id").join(redirects, "object_id", "left")
    order = F.struct("observed_at", "round_id", *(extra or []), "object_id")
    return e.groupBy(F.coalesce("canonical_id", "object_id").alias("canonical_id"), "level").agg(F.max(order).alias("r")).select("canonical_id", "level", "r.object_id", "r.round_id", "r.observed_at")


def after_cursor(events: DataFrame, seq: str, cursor: int, page: int) -> DataFrame:
    """The next page of an ordered log behind a cursor: a filter that reaches the scan, then the first rows."""
    return events.where(F.col(seq) > cursor).orderBy(seq).limit(page)


def sightings(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``kind``: 'append' for the first sighting of a key, 'refresh' for later ones."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_f"))
    return df.join(first, keys).withColumn("kind", F.when(F.struct(*order) == F.col("_f"), "append").otherwise("refresh")).drop("_f")


def supersede(rounds: DataFrame, id_: str = "id", started: str = "started_at", finished: str = "finished_at") -> DataFrame:
    """(id, state): a round still running when a later one starts is cancelled by it; the last one running is interrupted by a restart.

    Rounds are few (one row a run); the window over them all is bounded by that.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(started, id_)
    nxt = F.lead(started).over(w)
    return rounds.select(id_, F.when(F.col(finished).isNull() & nxt.isNull(), "interrupted").when(F.col(finished).isNull(), "cancelled").when(F.col(finished) > nxt, "overlapped").otherwise("done").alias("state"))


def alias_redirects(aliases: DataFrame, seen: DataFrame) -> DataFrame:
    """(object_id, canonical_id): objects that share an alias are one, and the oldest of them is canonical.

    aliases: (object_id, alias); seen: (object_id, first_seen). Objects meet the
    smallest object of each alias, not each other, so a common alias adds a star and no pairs.
    """
    a = aliases.where("object_id IS NOT NULL AND alias IS NOT NULL").distinct()
    hub = a.groupBy("alias").agg(F.min("object_id").alias("hub"))
    comp = connected_components(a.join(hub, "alias").select(F.col("object_id").alias("a"), F.col("hub").alias("b")))
    c = comp.select(F.col("node").alias("object_id"), "component").join(seen, "object_id")
    oldest = c.groupBy("component").agg(F.min_by("object_id", F.struct("first_seen", "object_id")).alias("canonical_id"))
    return c.join(oldest, "component").where("object_id <> canonical_id").select("object_id", "canonical_id")


def merged_draft(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, body, stale): the new render, but sections a person edited or locked stay, marked stale where the render differs or is gone.

    old: (section, body, kept); new: (section, body).
    """
    j = old.select("section", F.col("body").alias("ob"), "kept").join(new.select("section", F.col("body").alias("nb")), "section", "full_outer")
    hold = F.col("ob").isNotNull() & (F.coalesce("kept", F.lit(False)) | F.col("nb").isNull())
    return j.select("section", F.when(hold, F.col("ob")).otherwise(F.col("nb")).alias("body"), (hold & ~F.col("ob").eqNullSafe(F.col("nb"))).alias("stale"))


def cache_key(*parts: Column) -> Column:
    """Key of a model call: the hash of its parameters, kept apart by a zero byte."""
    return F.sha2(F.concat_ws("\0", *parts), 256)
