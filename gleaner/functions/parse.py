"""Parsing of texts, payloads and settings as Spark columns; blank and null inputs give null or empty results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_CHARS = 120
# fixed values: marks that scrapers put on a line of their own, and whose text follows
MARKERS = {"【视频字幕节选】": "primary", "【评论区 Top】": "community", "【评论区】": "community", "【回复精选】": "community", "【楼层讨论】": "community"}
MARKER_LINE = "^[ \\t]*({})[ \\t]*$".format("|".join(MARKERS))
COMMENTS = "--- Top Comments ---"
HEADING = "^#{1,6}[ \\t]+([^\\n]+)$"
BOUNDARY = "！？。!?…\\n,，｜|；"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, "^\\s+|\\s+$", "")


def title_and_body(title: Column, body: Column) -> Column:
    """struct(title, body): a paragraph that came as a title is cut at its first boundary from the eighth sign on, else at its last space; what is cut off is body."""
    t = strip(F.coalesce(title, F.lit("")))
    b = F.coalesce(body, F.lit(""))
    window = F.substring(t, 9, TITLE_CHARS - 7)
    run = F.length(F.regexp_extract(window, f"^[^{BOUNDARY}]*", 0))
    at = F.when(run < F.length(window), run + 8)
    head = F.substring(t, 1, TITLE_CHARS)
    space = F.length(F.regexp_extract(head, "(?s)^(.*) ", 1))
    cut = F.coalesce(at, F.when(space >= 20, space))
    whole = (F.length(t) <= TITLE_CHARS) | (strip(b) != "") | cut.isNull()
    first = strip(F.substring(t, F.lit(1), cut))
    return F.when(whole | (first == ""), F.struct(t.alias("title"), b.alias("body"))).otherwise(F.struct(first.alias("title"), strip(F.substring(t, cut + 2, F.length(t))).alias("body")))


def marker_sections(content: Column) -> Column:
    """array of struct(tier, marker, text): the author's text before the first marker line, then what stands under each."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), "^\\n+|\\n+$", "")
    parts = F.split(body, "(?dm)" + MARKER_LINE)
    marks = F.regexp_extract_all(body, F.lit("(?dm)" + MARKER_LINE), F.lit(1))
    tier = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    made = F.transform(parts, lambda p, i: F.struct(F.when(i == 0, "primary").otherwise(tier[F.get(marks, i - 1)]).alias("tier"), F.when(i > 0, F.get(marks, i - 1)).alias("marker"), strip(p).alias("text")))
    return F.filter(made, lambda x: x["text"] != "")


def markdown_sections(text: Column) -> Column:
    """array of struct(title, body): what stands before the first heading, and under each heading; empty ones are left out."""
    parts = F.split(F.coalesce(text, F.lit("")), "(?dm)" + HEADING)
    heads = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?dm)" + HEADING), F.lit(1))
    made = F.transform(parts, lambda p, i: F.struct(F.when(i == 0, "overview").otherwise(F.get(heads, i - 1)).alias("title"), strip(p).alias("body")))
    return F.filter(made, lambda x: x["body"] != "")


def comments_apart(content: Column) -> tuple[Column, Column]:
    """(main, comments): what stands before and behind the first comment mark."""
    at = F.instr(content, COMMENTS)
    n = len(COMMENTS)
    return strip(F.when(at > 0, F.substring(content, F.lit(1), at - 1)).otherwise(content)), F.when(at > 0, strip(F.substring(content, at + n, F.length(content)))).otherwise("")


def _object(s: Column) -> Column:
    """The text where it is a JSON object, else null."""
    return F.when(F.from_json(s, "map<string,string>").isNotNull() & strip(s).startswith("{") & strip(s).endswith("}"), s)


def lenient_json(reply: Column) -> Column:
    """A model's JSON object: the reply itself, a fenced block of it, or from its first brace to its last."""
    block = F.regexp_extract(reply, "(?s)```(?:json)?\\s*(.*?)```", 1)
    braces = F.regexp_extract(reply, "(?s)\\{.*\\}", 0)
    return F.coalesce(_object(reply), _object(block), _object(braces))


def canonical_map(m: Column) -> Column:
    """A map written with sorted keys and without spaces."""
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def redacted(m: Column, secret: str = "(?i)token|secret|password|api_?key") -> Column:
    """A map of strings whose secret values, told by their keys, are stars."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(secret) & v.isNotNull(), "***").otherwise(v.cast("string")))


def projected(m: Column, allowed: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(*allowed) & v.isNotNull())


# fixed values: words of speech that say nothing to a search
FILLER = ("please", "what", "which", "how", "why", "inside", "say", "says", "about", "from", "the", "an", "of", "in", "for", "and", "after", "is", "are", "to", "tell", "me")
FILLER_ZH = "请问|怎么样|什么|如何|为什么|哪些|推迟"
WORDS = "[\\p{IsLatin}0-9_+.-]{2,}|[\\x{4e00}-\\x{9fff}]{2,}"


def clean_query(raw: Column) -> tuple[Column, Column]:
    """(words, year): the words of a question that carry it, at most eight, and the first year in it."""
    found = F.regexp_extract_all(F.regexp_replace(raw, FILLER_ZH, " "), F.lit(WORDS), F.lit(0))
    words = F.array_distinct(F.filter(found, lambda w: ~F.lower(w).isin(*FILLER)))
    year = F.regexp_extract(raw, "(?:19|20)\\d{2}", 0)
    return F.array_join(F.slice(words, 1, 8), " "), F.when(year != "", year)


def retrieval_mode(needs_browser: Column, url: Column, fmt: Column) -> Column:
    return F.when(needs_browser, "browser").when(F.contains(url, F.lit("{query}")), "search").when(fmt == "rss", "feed").when(fmt == "html", "page").otherwise("snapshot")


def fill_url(template: str, **values: Column) -> Column:
    """An address template with its placeholders filled, values percent-encoded; unknown placeholders become empty."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(F.call_function("url_encode", v.cast("string")), F.lit("")))
    return F.regexp_replace(out, "\\{\\w+\\}", "")


def reachable(status: Column, text: Column, error: Column, least: int = 200) -> Column:
    """What a response is worth: the most specific reading first, since a page of status 200 can still be a wall."""
    low = F.lower(F.coalesce(text, F.lit("")))
    body = F.length(text) >= least
    v = F.when(error.isNotNull(), "error").when(low.rlike("captcha|are you human|验证码") & ~body, "blocked_captcha").when(low.rlike("sign in|log in|请登录|permission") & ~body, "blocked_auth")
    ok = status.between(200, 299)
    return v.when(ok & low.rlike('"error_code"\\s*:\\s*"?\\d+') & ~body, "signed_required").when(ok & body, "pass").when(ok, "list_only").otherwise("error")


def whole_segments(text: Column, limit: int, mark: str = "\\n\\n") -> Column:
    """The first segments of a text that fit whole into ``limit`` characters, their marks counted."""
    empty = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(a: Column, x: Column) -> Column:
        joined = F.when(a["s"] == "", x).otherwise(F.concat(a["s"], F.lit("\n\n"), x))
        fits = ~a["full"] & (F.length(joined) <= limit)
        return F.when(fits, F.struct(joined.alias("s"), F.lit(False).alias("full"))).otherwise(F.struct(a["s"].alias("s"), F.lit(True).alias("full")))

    return F.aggregate(F.filter(F.split(text, mark), lambda x: x != ""), empty, add)["s"]
