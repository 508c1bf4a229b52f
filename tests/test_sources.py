import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner.session import build_session  # noqa: F401
from gleaner.sources import exports, json_rows, markup, sinks
from gleaner.streaming import ingest


def test_json_rows(spark):
    spec = json_rows.SourceSpec("s", "news", "data.items", metrics={"likes": "m.likes"}, url_prefix="https://h.example")
    good = {"data": {"items": [{"title": "<b>A&amp;B</b>", "url": "/x", "created_at": "1700000000", "m": {"likes": "1.2万"}}, {"name": "no url"}, {"link": "https://h.example/2"}]}}
    d = spark.createDataFrame([(json.dumps(good),), ("not json",), (None,)], "value string")
    got = json_rows.parse(d, spec, F.lit("2025-09-15").cast("timestamp")).collect()
    assert [r["problem"] for r in got] == [None, "no_url", "no_title", "no_rows", "no_rows"]
    assert got[0]["title"] == "A&B" and got[0]["url"] == "https://h.example/x" and got[0]["metrics"] == {"likes": 12000} and got[1]["metrics"] == {"likes": None}


def test_mentions_and_windows(spark):
    d = spark.createDataFrame([("固态电池突破", ""), ("固态", "硬盘"), ("Solid battery", "x")], "title string, text string")
    assert [r[0] for r in json_rows.keep_mentioning(d, "固态电池").collect()] == ["固态电池突破"]
    w = json_rows.date_windows(spark, "2025-01-01", "2025-01-10", 4).collect()
    assert [(str(a), str(b)) for a, b in w] == [("2025-01-09", "2025-01-10"), ("2025-01-05", "2025-01-09"), ("2025-01-01", "2025-01-05")]


def test_feeds(spark):
    rss = "<rss><channel><item><title>T</title><link>https://a.example/1</link><pubDate>Mon, 01 Sep 2025 10:00:00 GMT</pubDate><description>d</description></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i1</id><title>U</title><link href="https://a.example/2"/><author><name>N</name></author></entry></feed>'
    d = spark.createDataFrame([(1, rss), (2, atom), (3, "<broken"), (4, None)], "k long, b string")
    got = {(r["k"], r["title"], r["url"], r["author"]) for r in markup.read_feeds(d, "k", "b").collect()}
    assert got == {(1, "T", "https://a.example/1", None), (2, "U", "https://a.example/2", "N")}


def test_html(spark):
    page = "<html><head><title>Site</title><meta name='author' content='Ann'></head><body><nav>menu</nav><h1>Big headline of the day</h1><p>First &amp; only.</p><a href='/x'>A long enough link</a><script>x()</script></body></html>"
    d = markup.html_document(page)
    assert d["title"] == "Big headline of the day" and "First & only." in d["text"] and "menu" not in d["text"] and d["author"] == "Ann" and d["links"] == ["/x"]
    rows = markup.html_headlines(spark.createDataFrame([(1, page), (2, None), (3, "")], "k long, h string"), "k", "h").orderBy("pos").collect()
    assert [(r["text"], r["url"]) for r in rows] == [("Big headline of the day", None), ("A long enough link", "/x")]


def _zip(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


def test_office(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    x = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    xlsx = _zip({"xl/sharedStrings.xml": f'<sst xmlns="{x}"><si><t>hi</t></si></sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{x}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row></sheetData></worksheet>'})
    d = spark.createDataFrame([("a.docx", bytearray(docx)), ("b.xlsx", bytearray(xlsx)), ("c.docx", bytearray(b"junk")), ("d.txt", bytearray(b"plain"))], "path string, content binary")
    got = {r["path"]: (r["text"], r["incomplete_reasons"]) for r in markup.read_documents(d).collect()}
    assert got == {"a.docx": ("One\na\tb", []), "b.xlsx": ("A1=hi\nB1=7", []), "c.docx": ("", ["BadZipFile"]), "d.txt": ("plain", [])}
    with pytest.raises(ValueError):
        markup.checked_zip(_zip({str(k): "" for k in range(markup.MAX_ENTRIES + 1)}))


def test_export(spark, tmp_path):
    items = [{"source_type": "rss", "title": "T", "url": "https://a.example/1", "sections": [{"tier": "primary", "text": "x"}]}, {"title": "no type", "url": "https://a.example/2"}, {"source_type": "rss", "title": "T", "url": "ftp://x"}, {"source_type": "rss", "title": "T", "locator": "l", "sections": [{"tier": "other"}]}]
    (tmp_path / "e.json").write_text(json.dumps({"items": items}))
    (tmp_path / "bad.json").write_text("{")
    got = [r["problem"] for r in exports.read_export(spark, str(tmp_path)).orderBy("file", "pos").collect()]
    assert sorted(map(str, got)) == ["None", "bad_tier", "bad_url", "no_items", "no_source_type"]


def test_journal_stream(spark, tmp_path):
    src = tmp_path / "j"
    src.mkdir()
    line = lambda b, rows, **k: json.dumps({"version": 1, "batch_id": b, "corpus_id": "c", "created_at": "2025-01-01T00:00:00", "rows": rows} | k)
    (src / "1.json").write_text(line("b1", ["r1", "r2"]) + "\n")
    (src / "2.json").write_text("{broken\n")
    (src / "3.json").write_text(line("b2", ["r2", "r3"]) + "\n" + line("b3", ["x"], created_at=None) + "\n")
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    for _ in range(2):  # a second run finds nothing new
        ingest.journal_stream(spark, str(src), out, bad, "t" + tmp_path.name)
    assert sorted(r["row"] for r in ingest.stored(spark, out).collect()) == ["r1", "r2", "r3"]
    assert spark.read.parquet(bad).count() == 2


def test_digests(spark, tmp_path):
    (tmp_path / "news-2025-03-04.md").write_text("# Top\n\n## [One](https://a.example/1)\n\nSummary one.\n\n### [Two](https://a.example/2)\n\n# not a summary\n")
    got = [(str(r[0]), r[1], r[3]) for r in exports.read_digests(spark, str(tmp_path)).collect()]
    assert got == [("2025-03-04", "One", "Summary one."), ("2025-03-04", "Two", "")]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "items")
    d = lambda rows: spark.createDataFrame(rows, "id string, x int")
    sinks.append_items(spark, p, d([("a", 1), ("b", 1)]))
    sinks.append_items(spark, p, d([("a", 2), ("c", 1)]))
    assert {tuple(r) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 1), ("c", 1)}
    assert {tuple(r) for r in sinks.upsert_latest(d([("a", 1)]), d([("a", 1), ("a", 3)]), ["id"], "x").collect()} == {("a", 3)}
    assert sinks.fill_template("#{a?limit=2}-#{b?split=,}-#{c}", {"a": "xyz", "b": "1,2"}) == "xy-1-"
    assert sinks.pack_paragraphs("aa\n\nbb\n\n" + "c" * 7, 6) == ["aa\n\nbb", "cccccc", "c"]
    for s in ("raw", "scored"):
        sinks.save_stage(d([("a", 1)]), str(tmp_path / "run"), s)
    sinks.save_stage(d([("a", 1)]), str(tmp_path / "run"), "raw")
    assert not (tmp_path / "run" / "scored").exists()
    r = spark.createDataFrame([("S", "A*", "https://x", "s")], "section string, title string, url string, summary string")
    assert "### [A\\*](https://x)" in sinks.render_digest(r, "D")
