"""Text, URL and identity functions as Spark columns (JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the archive tokeniser
STOP_WORDS = "a an and are as at be by for from in is it of on or the to was with".split()
WORD_PATTERN = "[a-z0-9]+(?:\\.[a-z0-9]+)*[+#]*|[\\x{3400}-\\x{9fff}]+"
TRACKING = ("utm_", "spm", "gclid", "fbclid")


def archive_tokens(text: Column) -> Column:
    """Latin words without stop words; overlapping bigrams of Han runs."""

    def one(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
        return F.when(w.rlike("^[\\x{3400}-\\x{9fff}]{2,}"), grams).when(w.isin(*STOP_WORDS), F.array().cast("array<string>")).otherwise(F.array(w))

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0)), one))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct character n-grams of lower-cased, space-collapsed text; the text itself where it is shorter."""
    body = F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))

    def grams(b: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(b) - (size - 1)), lambda i: F.substring(b, i, F.lit(size)))
        return F.when(F.length(b) >= size, F.array_distinct(cut)).when(F.length(b) > 0, F.array(b)).otherwise(F.array().cast("array<string>"))

    # the body is bound to a lambda variable once; captured directly it would be worked out again for every gram
    return F.transform(F.array(body), grams)[0]


def jaccard(a: Column, b: Column) -> Column:
    """0 where either side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def excerpt(text: Column, n: int = 400) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "\\s+", " ")), 1, n)


def head_middle_tail(text: Column, limit: int, head: float = 0.4, middle: float = 0.3) -> Column:
    """Text within ``limit`` as is; else its first, middle and last parts with markers between."""
    h, m = int(limit * head), int(limit * middle)
    t = limit - h - m
    n = F.length(text)
    mid = F.substring(text, F.floor((n - m) / 2).cast("int") + 1, F.lit(m))
    return F.when(n <= limit, text).otherwise(F.concat(F.substring(text, 1, h), F.lit("\n[...]\n"), mid, F.lit("\n[...]\n"), F.substring(text, F.greatest(n - t + 1, F.lit(1)), F.lit(t))))


def best_window(text: Column, terms: list[str], width: int, stride: int) -> Column:
    """The window of ``width`` characters with most term occurrences; the first of equals."""

    def pick(low: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(low) - 1, F.lit(0)), F.lit(stride))

        def hits(i: Column) -> Column:
            w = F.substring(low, i + 1, F.lit(width))
            total = F.lit(0)
            for t in terms:
                total = total + (F.length(w) - F.length(F.replace(w, F.lit(t.lower()), F.lit("")))) / len(t)
            return F.struct(total.cast("int").alias("hits"), (-i).alias("neg"))

        return F.array_max(F.transform(starts, hits))

    best = F.transform(F.array(F.lower(text)), pick)[0]
    return F.substring(text, F.lit(1) - best["neg"], F.lit(width))


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def registrable_domain(url: Column) -> Column:
    """Host without ``www.``; three labels under the fixed two-part suffixes."""
    host = F.regexp_replace(F.lower(url_part(url, "HOST")), "^www\\.", "")
    return F.when(host.rlike("\\.(co\\.uk|com\\.cn|co\\.jp|com\\.au|co\\.kr|org\\.uk)$"), F.regexp_extract(host, "([^.]+\\.[^.]+\\.[^.]+)$", 1)).otherwise(host)


def canonical_url(url: Column) -> Column:
    """http(s) only: lower scheme and host, no tracking parameters, sorted query, no fragment."""
    query = F.coalesce(url_part(url, "QUERY"), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_|spm=|gclid=|fbclid=)")))
    q = F.array_join(kept, "&")
    base = F.concat(F.lower(url_part(url, "PROTOCOL")), F.lit("://"), F.lower(url_part(url, "AUTHORITY")), F.coalesce(url_part(url, "PATH"), F.lit("")))
    return F.when(url.rlike("(?i)^https?://"), F.when(q != "", F.concat(base, F.lit("?"), q)).otherwise(base))


def dedup_key(url: Column) -> Column:
    """Scheme, user, host, port unless default, path without trailing slash, query without tracking in its own order."""
    scheme = F.lower(url_part(url, "PROTOCOL"))
    auth = F.lower(url_part(url, "AUTHORITY"))
    auth = F.when(scheme == "https", F.regexp_replace(auth, ":443$", "")).when(scheme == "http", F.regexp_replace(auth, ":80$", "")).otherwise(auth)
    path = F.regexp_replace(F.coalesce(url_part(url, "PATH"), F.lit("")), "/+$", "")
    query = F.array_join(F.filter(F.split(F.coalesce(url_part(url, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_|spm=|gclid=|fbclid=)")), "&")
    return F.concat_ws("|", scheme, auth, path, query)


def human_count(raw: Column) -> Column:
    """``1.2万``, ``3亿``, ``5k``, ``12,345`` as a number; null where there is none."""
    s = F.lower(F.regexp_replace(raw, "[,\\s]", ""))
    n = F.regexp_extract(s, "^([0-9]+(?:\\.[0-9]+)?)", 1)
    unit = F.when(s.contains("亿"), 100000000).when(s.contains("万") | s.rlike("w$"), 10000).when(s.rlike("m$"), 1000000).when(s.rlike("k$"), 1000).otherwise(1)
    return F.when(n != "", F.round(n.cast("double") * unit).cast("bigint"))


def parse_when(raw: Column, now: Column) -> Column:
    """Epoch seconds or milliseconds, ISO, RFC 822 and relative forms, against a pinned now; null where nothing fits."""
    s = F.trim(raw)
    rfc = F.regexp_replace(F.regexp_replace(s, "^[A-Za-z]{3}, *", ""), "(GMT|UTC|UT|Z)$", "+0000")
    digits = s.rlike("^[0-9]{10}([0-9]{3})?$")
    epoch = F.timestamp_micros((F.substring(s, 1, 10).try_cast("bigint") * 1000000))
    number = F.regexp_extract(s, "^([0-9]+)", 1).try_cast("int")
    back = F.when(s.rlike("^(今天|today)"), 0).when(s.rlike("^前天"), 2).otherwise(1)
    rel = (
        F.when(s.rlike("^[0-9]+ ?(秒|seconds?)"), now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), number))
        .when(s.rlike("^[0-9]+ ?(分钟|minutes?|mins?)"), now - F.make_dt_interval(F.lit(0), F.lit(0), number))
        .when(s.rlike("^[0-9]+ ?(小时|hours?)"), now - F.make_dt_interval(F.lit(0), number))
        .when(s.rlike("^[0-9]+ ?(天|days?)"), now - F.make_dt_interval(number))
        .when(s.rlike("^(今天|昨天|前天|today|yesterday)$"), now - F.make_dt_interval(back))
    )
    # a day with its clock time, and a month and day, which lie in the past
    clock = F.date_trunc("DAY", now) - F.make_dt_interval(back) + F.make_dt_interval(F.lit(0), F.regexp_extract(s, "(\\d{1,2}):\\d{2}", 1).try_cast("int"), F.regexp_extract(s, "\\d{1,2}:(\\d{2})", 1).try_cast("int"))
    this = F.try_to_timestamp(F.concat(F.year(now).cast("string"), F.lit("-"), s), F.lit("yyyy-M-d"))
    last = F.try_to_timestamp(F.concat((F.year(now) - 1).cast("string"), F.lit("-"), s), F.lit("yyyy-M-d"))
    rel = F.coalesce(F.when(s.rlike("^(今天|昨天|前天|today|yesterday)\\s*\\d{1,2}:\\d{2}$"), clock), F.when(s.rlike("^\\d{1,2}-\\d{1,2}$"), F.when(this > now, last).otherwise(this)), rel)
    return F.coalesce(F.when(digits, epoch), rel, F.try_to_timestamp(s), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(s, F.lit("yyyy/MM/dd")))


# fixed values: escapes in payloads, and entities, the ampersand last so that nothing is unescaped twice
ESCAPES = (("\\u003c", "<"), ("\\u003e", ">"), ("\\u0026", "&"), ("\\u0027", "'"), ("\\u0022", '"'), ("\\u002f", "/"), ("\\u003C", "<"), ("\\u003E", ">"), ("\\u002F", "/"), ("\\u00a0", " "), ("\\u200b", ""))
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#34;", '"'), ("&#x2F;", "/"), ("&#47;", "/"), ("&#60;", "<"), ("&#62;", ">"), ("&#160;", " "), ("&nbsp;", " "),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&#8217;", "’"), ("&#8216;", "‘"), ("&#8220;", "“"), ("&#8221;", "”"), ("&#38;", "&"), ("&amp;", "&"),
)


def clean_markup(raw: Column) -> Column:
    """Tags away, the common entities once, white space collapsed."""
    s = raw
    for a, b in ESCAPES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    s = F.regexp_replace(s, "<[^>]+>", " ")
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def normal_title(title: Column) -> Column:
    """A title without site suffix, space and punctuation, in lower case."""
    t = F.regexp_replace(title, "\\s+[|_–—-]\\s+[^|]{2,30}$", "")
    return F.lower(F.regexp_replace(t, "[\\s\\p{Punct}，。！？、：；“”‘’（）《》【】·…—]+", ""))


# fixed values: parameters of tracking and of request signing, which are no part of an address
TRACKING = "^(utm_|(ops_request_misc|request_id|biz_id|spm|share_token|share_source|from_source|xsec_token|xsec_source|channel_type|vd_source|scene|srcid|dist_request_id)=)"


def without_tracking(url: Column) -> Column:
    """The address without tracking parameters; the order of the others and the fragment stay."""
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    return F.concat(F.regexp_extract(url, "^[^?#]*", 0), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), F.regexp_extract(url, "#.*$", 0))


def url_verdict(url: Column) -> Column:
    """ok, or why an address may not be fetched: scheme, no_host, credentials, port, localhost, private."""
    at = F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(at), ":\\d+$", ""), "\\.$", "")
    port = F.regexp_extract(at, ":(\\d+)$", 1).try_cast("bigint")
    v = F.when(~url.rlike("(?i)^https?://"), "scheme").when(at == "", "no_host").when(F.contains(at, F.lit("@")), "credentials").when(~port.between(1, 65535), "port").when(host.rlike("(^|\\.)localhost$"), "localhost")
    return v.when(host.rlike("^(10\\.|127\\.|0\\.|169\\.254\\.|192\\.168\\.|172\\.(1[6-9]|2\\d|3[01])\\.)[\\d.]+$") | host.startswith("["), "private").otherwise("ok")


def machine_url(url: Column, patterns: tuple[str, ...]) -> Column:
    """Whether an address holds one of the patterns of machine endpoints, or names a host alone."""
    low = F.lower(url)
    return low.rlike("|".join(patterns)) | low.rlike("^https?://[^/]+/*$")


def community_key(url: Column, keys: dict[str, str]) -> Column:
    """The community a discussion's address belongs to, by the end of its host; code hosting only for issues and the like; else blank."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]*)", 1)), "^www\\.", "")
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    out = F.when(host == "github.com", F.when(path.rlike("^/[^/]+/[^/]+/(issues|pull|pulls|discussions)(/|$)"), "github_issues").otherwise(""))
    for suffix, key in keys.items():
        out = out.when((host == suffix) | host.endswith(suffix if suffix[0] in "-." else "." + suffix), key)
    return out.otherwise("")
