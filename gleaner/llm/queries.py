"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import boilerplate, leaks, neardup, normalise, packing, residue, spam, survivor, truncation
from gleaner.llm.common import items, spread, table
from gleaner.session import cut, drop

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.alike_pairs(spread(items(spark, sf, "title", "content", "author")), "id", ["title", "content", "author"])


@query
def p7_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.canonical_columns(items(spark, sf, "title", "content", "author").dropDuplicates(["id"]), ["title", "content", "author"])


def _residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_fields(spread(items(spark, sf, "publisher", "title", "content")), "id", "publisher", {"title": True, "content": False})


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _residue(spark, sf).select("id", "field_name")


@query
def p6_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Per field: residue that recurs across sources, what its words alone tell, and what only recurrence tells."""
    got = _residue(spark, sf)
    return got.groupBy("field_name").agg(F.count("*").alias("n"), F.count("sources").alias("recurring"), F.count_if(~F.col("sure")).alias("only_recurring"), F.max("sources").alias("most_sources"))


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    pages = spam.scored(spread(table(spark, sf, "documents").select("doc_id", "text", "source")), "doc_id", "text", "source")
    return pages.where("score > 0.5").select("doc_id").distinct()


@query
def p10_hosts(spark: SparkSession, sf: str) -> DataFrame:
    pages = spam.scored(spread(table(spark, sf, "documents").select("doc_id", "text", "source")), "doc_id", "text", "source")
    return pages.groupBy("host").agg(F.count("*").alias("pages"), F.sum((F.col("score") > 0.5).cast("bigint")).alias("spam"), F.round(F.max("host_rate"), 4).alias("host_rate"))


def _stripper(spark: SparkSession, sf: str) -> boilerplate.Stripper:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return boilerplate.fit([(spread(items(spark, sf, "content", "publisher")), "id", "content", "publisher"), (spread(docs), "doc_id", "text", "source")], docs)


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    model = _stripper(spark, sf)
    a = boilerplate.furniture_lines(spread(items(spark, sf, "content")), "id", "content", "corpus_items", model, True)
    b = boilerplate.furniture_lines(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", "documents", model, False)
    return a.distinct().unionByName(b.distinct())


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return leaks.leaks(docs, "doc_id", "text", table(spark, sf, "eval_passages"), "eval_id", "passage")


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "eval_id")


@query
def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each test item with the number of documents that hold it and the largest share held."""
    per = _leaks(spark, sf).groupBy("eval_id").agg(F.count("*").alias("n_docs"), F.round(F.max("covered"), 4).alias("most_covered"))
    return table(spark, sf, "eval_passages").select("eval_id", "suite").join(per, "eval_id", "left").fillna(0, ["n_docs"])


@query
def p9_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with leaked spans, how much of them goes and how long what is left is."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    got = leaks.removed(docs, "doc_id", "text", table(spark, sf, "eval_passages"), "eval_id", "passage")
    return got.select("doc_id", "spans", "removed_tokens", "tokens", F.length("text").alias("chars_left"))


def _cuts(spark: SparkSession, sf: str) -> DataFrame:
    a, b = items(spark, sf, "content", "publisher"), table(spark, sf, "documents").select("doc_id", "text", "source")
    a, b = spread(a), spread(b)
    tables = [(a, "id", "content", "publisher"), (b, "doc_id", "text", "source")]
    read = boilerplate.read_pages(tables)
    stripper = boilerplate.fit_whole(tables, read=read)
    model, trees = truncation.fit([(a, "id", "content"), (b, "doc_id", "text")], stripper, 1, read=read)
    drop(read)
    return truncation.cut_records([(a, "id", "content", "corpus_items"), (b, "doc_id", "text", "documents")], model, trees, 1, stripper)


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cuts(spark, sf)


@query
def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cut records per publisher (corpus_items) and per source (documents)."""
    a = items(spark, sf, "publisher", "content").where(F.length(F.trim("content")) > 0).dropDuplicates(["id"]).select(F.lit("corpus_items").alias("table_name"), F.col("id").alias("rec_id"), F.col("publisher").alias("origin"))
    b = table(spark, sf, "documents").where(F.length(F.trim("text")) > 0).select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("rec_id"), F.col("source").alias("origin"))
    got = _cuts(spark, sf).withColumn("hit", F.lit(1))
    per = a.unionByName(b.distinct()).join(got, ["table_name", "rec_id"], "left").groupBy("table_name", "origin").agg(F.count("*").alias("records"), F.count("hit").alias("cut"))
    return per.withColumn("share", F.round(F.col("cut") / F.col("records"), 6))


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    members, links = neardup.join(spread(items(spark, sf, "content", "publisher", "title")), "id", "content", "publisher", "title")
    return neardup.all_pairs(members, links)


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    a = spread(items(spark, sf, "cluster_id", "content", "fetched_at", "trust", "publisher"))
    tables = [(a, "id", "content", "publisher")]
    read = boilerplate.read_pages(tables)
    stripper = boilerplate.fit_whole(tables, read=read)
    model, _ = truncation.fit([(a, "id", "content")], stripper, graded=True, read=read)
    drop(read)
    return cut(survivor.completeness(survivor.text_grades(a, "id", "cluster_id", "content", "fetched_at", "trust", model)), "grades")


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.survivors(survivor.skyline(_graded(spark, sf))).select(F.col("grp").alias("cluster_id"), "id")


@query
def p2_merged(spark: SparkSession, sf: str) -> DataFrame:
    rows = _graded(spark, sf)
    a = items(spark, sf, "cluster_id", "title", "content", "author", "url", "publisher", "trust", "fetched_at")
    text = {k: (F.col(k), F.length(F.trim(k)) > 0) for k in ("title", "content", "author", "url", "publisher")}
    fields = text | {k: (F.col(k), F.col(k).isNotNull()) for k in ("trust", "fetched_at")}
    return survivor.merged(a, "id", "cluster_id", rows, survivor.skyline(rows), fields).withColumnRenamed("grp", "cluster_id")


@query
def p8_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return packing.assignment(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf, "containers"))


def p8_sound(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind, what an assignment may not have: texts of which a token is lost or placed twice, containers too full, texts split without need."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    sizes = packing.token_counts(docs, "doc_id", "text")
    kinds = F.broadcast(table(spark, sf, "containers").select("container_kind", "capacity_tokens"))  # a fixed table of three rows
    got = cut(packing.assignment(docs, "doc_id", "text", table(spark, sf, "containers")), "assigned")
    per = got.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.max(F.col("start_token") + F.col("n_tokens")).alias("reach"), F.countDistinct("start_token").alias("starts"), F.count("*").alias("parts"))
    every = sizes.join(kinds).join(per, ["container_kind", "doc_id"], "left")
    whole = (F.col("placed") == F.col("n")) & (F.col("reach") == F.col("n")) & (F.col("starts") == F.col("parts"))
    a = every.groupBy("container_kind").agg(F.count_if(~F.coalesce(whole, F.lit(False))).alias("lost"), F.count_if((F.col("n") <= F.col("capacity_tokens")) & (F.col("parts") > 1)).alias("split"))
    full = got.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t")).join(kinds, "container_kind")
    b = full.groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    return a.join(b, "container_kind").select("container_kind", "lost", "overfull", "split")


QUERIES["p8_sound"] = p8_sound
ORACLES["p8_sound"] = "SELECT container_kind, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split FROM containers"


@query
def p8_waste(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and unused share per kind, against the fewest containers possible by volume."""
    got = p8_assignment(spark, sf).groupBy("container_kind").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("tokens"))
    per = got.join(F.broadcast(table(spark, sf, "containers")), "container_kind")
    return per.select("container_kind", "capacity_tokens", "n_containers", "tokens", F.round(1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"))


@query
def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per item of a group of near-identical texts: its group (smallest class number) and how many texts it is alike to."""
    members, links = neardup.join(spread(items(spark, sf, "content", "publisher", "title")), "id", "content", "publisher", "title")
    return neardup.grouped(members, links)
