"""Feeds, HTML pages and office documents: bytes are parsed in Arrow batches, everything after is columns."""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES, MAX_BYTES = 4096, 40 << 20
MAX_SHEETS, MAX_ROWS, MAX_COLS = 20, 5000, 128


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def feed_entries(body: str) -> list[dict]:
    """Items of RSS or Atom whatever their namespaces; nothing for a feed that does not parse."""
    try:
        root = ElementTree.fromstring(body.strip().encode("utf-8"))
    except (ElementTree.ParseError, ValueError):
        return []
    out = []
    for e in root.iter():
        if _local(e.tag) not in ("item", "entry"):
            continue
        got: dict = {}
        for c in e:
            k = _local(c.tag)
            v = (c.text or "").strip()
            if k == "link":
                v = v or c.attrib.get("href", "")
            elif k == "author" and not v:
                v = next(((x.text or "").strip() for x in c if _local(x.tag) == "name"), "")
            if v:
                got.setdefault({"guid": "id", "updated": "published", "pubdate": "published", "creator": "author", "description": "summary", "content": "summary", "encoded": "summary"}.get(k, k), v)
        out.append(got)
    return out


def read_feeds(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, entry_id, title, url, author, published, summary); entry_id hashes the feed's own id or the link."""

    def run(batches):
        for b in batches:
            rows = [(k, e.get("id") or e.get("link"), e.get("title"), e.get("link"), e.get("author"), e.get("published"), e.get("summary")) for k, t in zip(b["_k"], b["_b"]) if isinstance(t, str) for e in feed_entries(t)]
            yield pd.DataFrame(rows, columns=["_k", "native", "title", "url", "author", "published", "summary"])

    kind = dict(bodies.dtypes)[key]
    d = bodies.select(F.col(key).alias("_k"), F.col(body).alias("_b")).mapInPandas(run, f"_k {kind}, native string, title string, url string, author string, published string, summary string")
    return d.select(F.col("_k").alias(key), F.substring(F.sha2("native", 256), 1, 16).alias("entry_id"), "title", "url", "author", "published", "summary")


def html_headlines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, text, url): headings of 12-200 characters, then anchors of 10-200, each text once; JVM only."""
    from gleaner.functions.text import clean_markup

    h = F.regexp_extract_all(html, F.lit("(?is)<h[1-4][^>]*>(.*?)</h[1-4]>"), F.lit(1))
    a_text = F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*href=[\"']([^\"'#][^\"']*)[\"'][^>]*>(.*?)</a>"), F.lit(2))
    a_url = F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*href=[\"']([^\"'#][^\"']*)[\"'][^>]*>(.*?)</a>"), F.lit(1))
    heads = pages.select(key, F.posexplode(h).alias("pos", "t")).select(key, F.lit(0).alias("grp"), "pos", "t", F.lit(None).cast("string").alias("url"))
    links = pages.select(key, F.posexplode(F.arrays_zip(a_text.alias("t"), a_url.alias("url"))).alias("pos", "z")).select(key, F.lit(1).alias("grp"), "pos", "z.t", "z.url")
    rows = heads.unionByName(links).withColumn("text", clean_markup(F.col("t")))
    rows = rows.where(F.length("text").between(F.when(F.col("grp") == 0, 12).otherwise(10), 200))
    first = rows.groupBy(key, "text").agg(F.min(F.struct("grp", "pos", "url")).alias("r"))
    return first.select(key, (F.col("r.grp") * 100000 + F.col("r.pos")).alias("pos"), "text", "r.url")


class _Page(HTMLParser):
    DROP = {"script", "style", "nav", "footer", "aside", "form", "noscript", "template", "svg"}
    VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
    BLOCK = {"p", "div", "section", "article", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "br", "table", "ul", "ol", "main", "header"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.open: list[str] = []
        self.out: list[str] = []
        self.title, self.h1 = "", ""
        self.links: list[str] = []
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            self.meta[(a.get("property") or a.get("name") or "").lower()] = a.get("content") or ""
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in self.VOID:
            if tag == "br":
                self.out.append("\n")
            return
        self.open.append(tag)
        if tag in self.DROP:
            self.skip.append(tag)
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        if tag in self.skip:
            self.skip.remove(tag)
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if self.open and self.open[-1] == "title":
            self.title += data
        elif not self.skip:
            if self.open and self.open[-1] == "h1":
                self.h1 += data
            self.out.append(data)


def html_document(html: str) -> dict:
    """Title (first h1, else title), main text by lines, links, publication time and author of a page."""
    p = _Page()
    try:
        p.feed(html)
    except (AssertionError, ValueError):
        pass
    text = "\n".join(x for x in (" ".join(y.split()) for y in "".join(p.out).split("\n")) if x)
    return {"title": " ".join((p.h1 or p.title).split()), "text": text, "links": list(dict.fromkeys(p.links)), "published": p.meta.get("article:published_time") or p.meta.get("date"), "author": p.meta.get("author") or p.meta.get("article:author")}


def checked_zip(blob: bytes) -> zipfile.ZipFile:
    """An office archive that is neither encrypted nor a bomb."""
    z = zipfile.ZipFile(io.BytesIO(blob))
    info = z.infolist()
    if len(info) > MAX_ENTRIES or sum(i.file_size for i in info) > MAX_BYTES or any(i.flag_bits & 1 for i in info):
        raise ValueError("archive out of bounds")
    return z


def docx_text(blob: bytes) -> tuple[str, list[str]]:
    """Paragraphs and table rows in order, and what was left out."""
    z = checked_zip(blob)
    body = ElementTree.fromstring(z.read("word/document.xml"))
    lines, reasons = [], []
    root = next((e for e in body if _local(e.tag) == "body"), body)

    def words(e) -> str:
        return "".join((t.text or "") if _local(t.tag) == "t" else "\t" if _local(t.tag) == "tab" else "" for t in e.iter()).strip()

    for e in root:
        if _local(e.tag) == "p" and words(e):
            lines.append(words(e))
        elif _local(e.tag) == "tbl":
            for r in e:
                if _local(r.tag) == "tr":
                    cells = [c for c in r if _local(c.tag) == "tc"]
                    if any(_local(x.tag) == "tbl" for c in cells for x in c.iter()):
                        reasons.append("nested_table_not_extracted")
                    lines.append("\t".join(words(c) for c in cells))
    return "\n".join(lines), sorted(set(reasons))


def _column(ref: str) -> int:
    """Zero-based column of a cell reference such as ``AB12``."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx_text(blob: bytes) -> tuple[str, list[str]]:
    """``A1=value`` lines of each sheet, within bounds, and which bounds were met."""
    z = checked_zip(blob)
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    lines, reasons = [], set()
    sheets = sorted(n for n in names if n.startswith("xl/worksheets/sheet") and n.endswith(".xml"))
    if len(sheets) > MAX_SHEETS:
        reasons.add("sheet_limit")
    rows = 0  # over all sheets
    for n in sheets[:MAX_SHEETS]:
        for row in (e for e in ElementTree.fromstring(z.read(n)).iter() if _local(e.tag) == "row"):
            rows += 1
            if rows > MAX_ROWS:
                reasons.add("row_limit")
                break
            for k, c in enumerate(row):
                if max(k, _column(c.attrib.get("r", ""))) >= MAX_COLS:  # absent cells count too
                    reasons.add("cell_limit")
                    break
                v = next((x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")), "")
                if c.attrib.get("t") == "s" and v.isdigit() and int(v) < len(shared):
                    v = shared[int(v)]
                if v:
                    lines.append(f"{c.attrib.get('r', '')}={v}")
    return "\n".join(lines), sorted(reasons)


def read_documents(files: DataFrame) -> DataFrame:
    """(path, doc_format, title, text, links, incomplete_reasons) of a binaryFile frame: HTML, DOCX, XLSX, sitemap and text."""

    def one(path: str, blob: bytes) -> tuple:
        ext = path.rsplit(".", 1)[-1].lower()
        try:
            if ext == "docx":
                t, r = docx_text(blob)
                return path, "docx", None, t, [], r
            if ext == "xlsx":
                t, r = xlsx_text(blob)
                return path, "xlsx", None, t, [], r
            s = blob.decode("utf-8", "replace")
            if ext == "xml" and "<urlset" in s[:2000]:
                return path, "sitemap", None, "", [(e.text or "").strip() for e in ElementTree.fromstring(s.encode()).iter() if _local(e.tag) == "loc"], []
            if ext in ("html", "htm"):
                d = html_document(s)
                return path, "html", d["title"], d["text"], d["links"], []
            if ext == "pdf":
                return path, "pdf", None, "", [], ["no_pdf_reader"]
            return path, "text", None, s, [], []
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as x:
            return path, ext, None, "", [], [type(x).__name__]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([one(p, bytes(c)) for p, c in zip(b["path"], b["content"])], columns=["path", "doc_format", "title", "text", "links", "incomplete_reasons"])

    return files.select("path", "content").mapInPandas(run, "path string, doc_format string, title string, text string, links array<string>, incomplete_reasons array<string>")
