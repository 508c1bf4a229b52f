"""Claims, stories, rounds and the functions they rest on, on small fixtures with their defined cases."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import claims as C
from gleaner.operators import merge, retrieval
from gleaner.operators import rounds as R
from gleaner.operators import stories as S


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def test_term_candidates(spark):
    assert one(spark, "Acme-2 sells the 大模型开源 kit", C.term_candidates) == ["acme-2", "sells", "大模型", "模型开", "型开源", "大模", "模型", "型开", "开源", "kit"]
    assert one(spark, None, C.term_candidates) == [] and one(spark, " ", C.term_candidates) == []


@pytest.mark.parametrize(("term", "blob", "want"), [("60", "the xbox 360 and 600ml", False), ("60", "about 60 people", True), ("模型", "新大模型", True), ("", "x", False), ("c++", "in c++ today", True), ("safe", "safely", False)])
def test_mentions(spark, term, blob, want):
    d = spark.createDataFrame([(term, blob)], "t string, b string")
    assert d.select(C.mentions(F.col("t"), F.col("b")).alias("r")).first()["r"] is want


def test_discriminating_and_links(spark):
    items = spark.createDataFrame([("1", "Acme robot wins", "the robot of acme", 9), ("2", "Other news", "a robot", 9), ("3", None, None, 9), ("1", "Acme robot wins", "the robot of acme", 9)], "item_id string, title string, content string, level int").dropDuplicates(["item_id"])
    claims = spark.createDataFrame([("c", "Acme robot", "3"), ("n", None, "1")], "claim_id string, text string, origin string")
    dfs = C.document_frequency(items.select("item_id", F.concat_ws(" ", "title", "content").alias("b")), "item_id", "b")
    t = C.discriminating(claims, "claim_id", "text", dfs, 3)
    assert {r["claim_id"]: r["terms"] for r in t.collect()} == {"c": ["robot", "acme"]}
    got = C.link_evidence(t.join(claims.select("claim_id", "origin"), "claim_id"), items).collect()
    assert [(r["claim_id"], r["item_id"], r["shared"], r["place"]) for r in got] == [("c", "1", 2, 1)]
    assert C.link_evidence(t.join(claims.select("claim_id", "origin"), "claim_id").limit(0), items).count() == 0


def test_statements(spark):
    said = ["The bridge was closed in May.", "the BRIDGE was closed in may", "No", "A new bridge opens in June"]
    assert one(spark, said, C.distinct_statements, "array<string>") == [said[0], said[3]]


def test_titles(spark):
    assert one(spark, "A &amp; B 发布新品_哔哩哔哩", S.normal) == one(spark, "A & B 发布新品", S.normal)
    assert one(spark, "钠离子电池加速走向应用场 - 钠离子电池加速走向应用场", lambda c: S.without_repeat(S.normal(c))) == "钠离子电池加速走向应用场"
    key = lambda t, u="": spark.createDataFrame([(t, u)], "t string, u string").select(S.cluster_key(F.col("t"), F.col("u")).alias("r")).first()["r"]
    assert key("可以凌空飞踢！中国人形机器人走上世界舞台") == key("中国人形机器人走上世界舞台")
    assert key("abc", "https://a.example/1") == "u:https://a.example/1" and key("", "") is None and key(None) is None


def test_prefix_buckets(spark):
    keys = [("abcdefgh",), ("abcdefghij",), ("abcdefghijk",), ("abcdefg",), ("u:abcdefghi",), (None,), ("abcdefgh",)]
    got = {tuple(r) for r in S.prefix_buckets(spark.createDataFrame(keys, "key string")).collect()}
    assert got == {("abcdefgh", "abcdefgh"), ("abcdefghij", "abcdefgh"), ("abcdefghijk", "abcdefgh"), ("abcdefg", "abcdefg"), ("u:abcdefghi", "u:abcdefghi")}


def test_numbered_within_equals_a_window(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).alias("n"), "id")
    got = merge.numbered_within(d, "g", ["n", "id"], "place", 8).select("id", "place").collect()
    rows = sorted((r["g"], r["n"], r["id"]) for r in d.collect())
    want, seen = {}, {}
    for g, _, i in rows:
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert {r["id"]: r["place"] for r in got} == want
    assert merge.numbered_within(d.limit(0), "g", ["n", "id"], "place").count() == 0


def test_supersede_and_draft(spark):
    at = lambda d: datetime.datetime(2025, 1, d)
    r = spark.createDataFrame([(1, at(1), None), (2, at(2), at(4)), (3, at(3), at(3)), (4, at(5), None)], "id long, started_at timestamp, finished_at timestamp")
    assert {x["id"]: x["state"] for x in R.supersede(r).collect()} == {1: "cancelled", 2: "overlapped", 3: "done", 4: "interrupted"}
    old = spark.createDataFrame([("a", "mine", True), ("b", "old", False), ("c", "gone", None)], "section string, body string, kept boolean")
    new = spark.createDataFrame([("a", "theirs"), ("b", "new"), ("d", "fresh")], "section string, body string")
    assert {tuple(x) for x in R.merged_draft(old, new).collect()} == {("a", "mine", True), ("b", "new", False), ("c", "gone", True), ("d", "fresh", False)}


def test_alias_redirects(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("y", "2"), ("z", "2"), ("q", "3"), (None, "1"), ("p", None)], "object_id string, alias string")
    s = spark.createDataFrame([("x", 3), ("y", 1), ("z", 2), ("q", 1)], "object_id string, first_seen int")
    assert {tuple(r) for r in R.alias_redirects(a, s).collect()} == {("x", "y"), ("z", "y")}


def test_index_equals_one_pass(spark):
    d = spark.createDataFrame([(1, "open data open"), (2, "closed data"), (3, None), (4, "")], "k long, t string")
    q = spark.createDataFrame([("a", "open"), ("a", "data")], "query_id string, term string")
    import tempfile

    path = tempfile.mkdtemp()
    retrieval.build_index(d, "k", F.col("t"), path)
    got = retrieval.search_index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), [("a", "open"), ("a", "data")], "k")
    assert {(r["k"], round(r["score"], 9)) for r in got.collect()} == {(r["k"], round(r["score"], 9)) for r in retrieval.bm25(d, "k", F.col("t"), q).collect()}


NOW = datetime.datetime(2025, 9, 15, 12, 0)


@pytest.mark.parametrize(("raw", "want"), [("昨天 20:25", datetime.datetime(2025, 9, 14, 20, 25)), ("前天 01:05", datetime.datetime(2025, 9, 13, 1, 5)), ("08-30", datetime.datetime(2025, 8, 30)), ("12-24", datetime.datetime(2024, 12, 24)), ("3天前", datetime.datetime(2025, 9, 12, 12, 0)), ("02-30", None), ("soon", None), (None, None)])
def test_relative_dates(spark, raw, want):
    d = spark.createDataFrame([(raw, NOW)], "v string, n timestamp")
    assert d.select(T.parse_when(F.col("v"), F.col("n")).alias("r")).first()["r"] == want


def test_addresses_and_markup(spark):
    assert one(spark, "https://a.example/x?utm_source=1&b=2#f", T.without_tracking) == "https://a.example/x?b=2#f"
    verdicts = {"ftp://a": "scheme", "http://u:p@a.example/": "credentials", "http://10.0.0.1/": "private", "http://localhost/": "localhost", "http://a.example:0/": "port", "https://a.example:8080/x": "ok", "https:///x": "no_host"}
    assert {u: one(spark, u, T.url_verdict) for u in verdicts} == verdicts
    assert one(spark, "\\u003cem\\u003eA\\u003c/em\\u003e &#8217;s &amp;amp;", T.clean_markup) == "A ’s &amp;"
