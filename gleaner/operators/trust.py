"""The trust model: features, logistic score, publishers, aggregation and the verdict gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import registrable_domain

# fixed values: coefficients of the logistic model
BIAS, PRIOR, AUTHOR, SUPPORT, ENTITY, FRESH, PROVENANCE, TEMPLATE = -1.20, 1.10, 0.45, 0.55, 0.60, 0.35, 0.80, 0.90
SAME_FAMILY = 0.5
# fixed values: cut points of the gate
SUPPORTED, FAMILY_PUBLISHERS, FAMILY_PRIOR = 0.55, 3, 0.40
# fixed values: how far a section's text carries its author's voice
VOICE = {"author": 1.0, "transcript": 0.95, "vlm": 0.6, "legacy_marker": 0.8, "manual_export": 0.85}


def provenance_factor(provenance: Column, confidence: Column) -> Column:
    out = F.when(provenance == "ocr", F.coalesce(confidence, F.lit(0.5)))
    for k, v in VOICE.items():
        out = out.when(provenance == k, F.lit(v))
    return out.otherwise(F.lit(0.8))


def freshness(published: Column, now: Column, half_life_days: float = 90.0) -> Column:
    """0.5 where the age is unknown."""
    age = F.greatest((F.unix_micros(now) - F.unix_micros(published)) / F.lit(86400e6), F.lit(0.0))
    return F.when(published.isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(0.5), age / half_life_days))


def entity_checkable(text: Column) -> Column:
    """Share of three of five signals that a reader could check something."""
    body = F.coalesce(text, F.lit(""))
    signals = [
        body.rlike("[A-Za-z][A-Za-z0-9._+-]{2,}"),
        body.rlike("[0-9]|亿|万|千亿|美元|美金|元|人民币|%"),
        body.rlike("(?i)https?://|www\\.|\\.com|\\.org|\\.cn"),
        body.rlike("\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b"),
        body.rlike("[\\x{3400}-\\x{9fff}]") & (F.length(body) > 40),
    ]
    total = signals[0].cast("int")
    for s in signals[1:]:
        total = total + s.cast("int")
    return F.least(F.lit(1.0), total / F.lit(3.0))


def score(prior: Column, author: Column, support: Column, entity: Column, fresh: Column, provenance: Column, template: Column) -> Column:
    z = F.lit(BIAS) + PRIOR * prior + AUTHOR * author + SUPPORT * support + ENTITY * entity + FRESH * fresh + PROVENANCE * provenance - TEMPLATE * template
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def publisher_of(author: Column, locator: Column, url: Column, platforms: list[str]) -> Column:
    """The site, unless it is a platform; then the author; then a user named in the locator or URL; else null (casts no vote)."""
    host = registrable_domain(url)
    name = F.lower(F.trim(author))
    found = [F.regexp_extract(F.coalesce(c, F.lit("")), "(?:^|[/#@])u(?:ser)?/([^/?#&]+)", 1) for c in (locator, url)]
    at = [F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), "^@([\\w.\\-]+)", 1) for c in (locator, url)]
    fallback = [F.when(x != "", F.lower(x)) for pair in zip(found, at) for x in pair]
    return F.coalesce(F.when((host != "") & ~host.isin(*platforms), host), F.when(name != "", name), *fallback)


def collapse_votes(votes: DataFrame, claim: str) -> DataFrame:
    """One vote per claim and cluster: the strongest; null trust counts 0.5, an item without cluster stands alone."""
    v = votes.withColumn("cluster", F.coalesce("cluster", "item_id")).withColumn("trust", F.coalesce("trust", F.lit(0.5)))
    best = F.struct("trust", "publisher", "source_type", "item_id")
    return v.groupBy(claim, "cluster").agg(F.max(best).alias("v")).select(claim, "cluster", "v.trust", "v.publisher", "v.source_type", "v.item_id")


def noisy_or(votes: DataFrame, claim: str) -> DataFrame:
    """(claim, confidence, families, publishers): 1 - prod(1 - trust * d) over distinct publishers, strongest first; d halves repeats of a family."""
    v = votes.where("publisher IS NOT NULL")
    one = Window.partitionBy(claim, "source_type", "publisher").orderBy(F.desc("trust"), "item_id")
    fam = Window.partitionBy(claim, "source_type").orderBy(F.desc("trust"), "publisher")
    v = v.withColumn("r", F.row_number().over(one)).where("r = 1").withColumn("d", F.when(F.row_number().over(fam) == 1, 1.0).otherwise(SAME_FAMILY))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trust")))
    return v.groupBy(claim).agg((1 - F.product(1 - t * F.col("d"))).alias("confidence"), F.countDistinct("source_type").alias("families"), F.countDistinct("source_type", "publisher").alias("publishers"))


def verdict(confidence: Column, families: Column, publishers: Column, prior: Column, contradicted: Column | None = None) -> Column:
    ok = (confidence >= SUPPORTED) & ((families >= 2) | ((families == 1) & (publishers >= FAMILY_PUBLISHERS) & (prior >= FAMILY_PRIOR)))
    out = F.when(contradicted, "contested") if contradicted is not None else F.when(F.lit(False), "contested")
    return out.when(ok, "supported").otherwise("unsupported")


def author_rank(author: Column, level: Column, verified: Column) -> Column:
    """A source-visible level from 0 to 20, else verification, else a name, else nothing."""
    by_level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.3) + level / 20.0))
    return F.when(level >= 0, by_level).when(verified, 0.9).when(F.trim(F.coalesce(author, F.lit(""))) != "", 0.5).otherwise(0.4)
