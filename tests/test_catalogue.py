"""Endpoints as data, the planner and collector shards."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import parse as P
from gleaner.sources import catalogue, json_rows

PAYLOADS = {
    "hackernews": ({"hits": [{"title": "A <b>lamp</b>", "url": "https://a.example/1", "created_at_i": 1756500000, "points": 7, "num_comments": None}]}, ("A lamp", "https://a.example/1", {"likes": 7, "replies": None})),
    "reddit": ({"data": {"children": [{"data": {"title": "Q", "permalink": "/r/x/1", "created_utc": 1756500000, "author": "u", "score": 3}}]}}, ("Q", "https://www.reddit.com/r/x/1", {"likes": 3, "replies": None})),
    "v2ex": ([{"title": "题", "url": "https://www.v2ex.com/t/1", "created": 1756500000, "replies": 2}], ("题", "https://www.v2ex.com/t/1", {"replies": 2})),
    "crossref": ({"message": {"items": [{"title": ["T"], "URL": "https://doi.org/1", "created": {"date-time": "2025-08-29T20:40:00Z"}, "is-referenced-by-count": 5}]}}, ("T", "https://doi.org/1", {"cites": 5})),
}


@pytest.mark.parametrize("key", PAYLOADS)
def test_endpoints(spark, key):
    spec = next(e.spec for e in catalogue.ENDPOINTS if e.spec.key == key)
    payload, (title, url, metrics) = PAYLOADS[key]
    d = spark.createDataFrame([(json.dumps(payload),), ("{broken",), (None,)], "value string")
    rows = json_rows.parse(d, spec, F.lit(datetime.datetime(2025, 9, 15))).collect()
    good = [r for r in rows if r["problem"] is None]
    assert [(r["title"], r["url"], r["metrics"]) for r in good] == [(title, url, metrics)]
    assert good[0]["published_at"] == datetime.datetime(2025, 8, 29, 20, 40)
    assert sorted(r["problem"] for r in rows if r["problem"]) == ["no_rows", "no_rows"]


def test_plan():
    got = catalogue.planned({"zh"}, keys=set())
    assert [r for _, r in got if r == ""] and got[0][0].mode == "search" and {e.spec.key: r for e, r in got}["hackernews"] == "coverage"
    assert {e.spec.key: r for e, r in catalogue.planned({"en"})}["youtube"] == "key"
    assert len({e.spec.key for e in catalogue.ENDPOINTS}) == len(catalogue.ENDPOINTS)


def test_shards(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"id": "1", "t": "late"}\n{"id": "2", "t": "x"}\n')
    (tmp_path / "a.json").write_text('{"id": "1", "t": "first"}\n{bad\n{"t": "no key"}\n')
    got = catalogue.read_shards(spark, f"{tmp_path}/*.json", "id string, t string", "id")
    assert {tuple(r) for r in got.collect()} == {("1", "first"), ("2", "x")}


def test_parsing(spark):
    one = lambda v, fn: spark.createDataFrame([(v,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]
    long_ = "The council sold the archive! " + "And then it went on about other things for a long while " * 3
    assert tuple(one(long_, lambda c: P.title_and_body(c, F.lit(None)))) == ("The council sold the archive", long_[30:].strip())
    assert tuple(one("Short title", lambda c: P.title_and_body(c, F.lit("b")))) == ("Short title", "b")
    assert tuple(one(None, lambda c: P.title_and_body(c, F.lit(None)))) == ("", "")
    assert [tuple(x) for x in one("head\n【评论区】\na\n【视频字幕节选】\n\nb", P.marker_sections)] == [("primary", None, "head"), ("community", "【评论区】", "a"), ("primary", "【视频字幕节选】", "b")]
    assert one(None, P.marker_sections) == [] and one("text 【评论区】 inline", P.marker_sections)[0]["text"].endswith("inline")
    assert [tuple(x) for x in one("pre\n# A\nx\n## B\n\n### C\ny", P.markdown_sections)] == [("overview", "pre"), ("A", "x"), ("C", "y")]
    assert one('So: ```json\n{"a": 1}\n``` ok', P.lenient_json) == '{"a": 1}\n' and one("none", P.lenient_json) is None and one('x {"a": {"b": 2}} y', P.lenient_json) == '{"a": {"b": 2}}'
    assert one("a\n\nbb\n\ncccc", lambda c: P.whole_segments(c, 6)) == "a\n\nbb"
