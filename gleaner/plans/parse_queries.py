"""Parsing, filtering and searching queries, with their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import parse as P
from gleaner.operators.conjunction import Postings, per_block
from gleaner.plans.text_queries import ITEMS, items, load

QUERIES: dict = {}
ORACLES: dict = {}
NOW = "2025-09-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_B = "！？。!?…\\n,，｜|；"


@query(f"""WITH t AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS t FROM documents), w AS (SELECT *, substr(t, 9, 113) AS w, length(regexp_extract(substr(t, 9, 113), '^[^{_B}]*')) AS run, length(regexp_extract(substr(t, 1, 120), '(?s)^(.*) ', 1)) AS sp FROM t),
c AS (SELECT *, CASE WHEN run < length(w) THEN run + 8 WHEN sp >= 20 THEN sp END AS cut FROM w)
SELECT doc_id, CASE WHEN length(t) <= 120 OR cut IS NULL OR {_STRIP.format("substr(t, 1, cut)")} = '' THEN t ELSE {_STRIP.format("substr(t, 1, cut)")} END AS title, CASE WHEN length(t) <= 120 OR cut IS NULL OR {_STRIP.format("substr(t, 1, cut)")} = '' THEN '' ELSE {_STRIP.format("substr(t, cut + 2)")} END AS body FROM c""")
def title_body_split(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", P.title_and_body(F.col("text"), F.lit("")).alias("r")).select("doc_id", "r.title", "r.body")


_MARKED = "coalesce(content, '') || chr(10) || '【评论区】' || chr(10) || coalesce(author, '') || chr(10) || '  【视频字幕节选】' || chr(10) || title"
_ML = P.MARKER_LINE.replace("\\t", "\\t")


@query(f"""WITH b AS (SELECT id, regexp_replace({_MARKED}, '^\\n+|\\n+$', '', 'g') AS b FROM {ITEMS} WHERE title IS NOT NULL), p AS (SELECT id, unnest(regexp_split_to_array(b, '(?m){P.MARKER_LINE}')) AS p, generate_subscripts(regexp_split_to_array(b, '(?m){P.MARKER_LINE}'), 1) AS i, regexp_extract_all(b, '(?m){P.MARKER_LINE}', 1) AS m FROM b),
s AS (SELECT id, CASE WHEN i > 1 THEN m[i - 1] END AS marker, {_STRIP.format("p")} AS text FROM p) SELECT id, CASE WHEN marker IS NULL OR marker = '【视频字幕节选】' THEN 'primary' ELSE 'community' END AS tier, count(*) AS n, sum(length(text)) AS chars FROM s WHERE text <> '' GROUP BY id, tier""")
def marker_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Per item and tier: how many sections its marker lines make, and how long they are."""
    body = F.concat(F.coalesce("content", F.lit("")), F.lit("\n【评论区】\n"), F.coalesce("author", F.lit("")), F.lit("\n  【视频字幕节选】\n"), F.col("title"))
    d = items(spark, sf, "content", "author", "title").where("title IS NOT NULL").select("id", F.explode(P.marker_sections(body)).alias("s"))
    return d.groupBy("id", F.col("s.tier").alias("tier")).agg(F.count("*").alias("n"), F.sum(F.length("s.text")).alias("chars"))


@query(f"""WITH b AS (SELECT id, CASE WHEN length(id) % 2 = 0 THEN coalesce(content, '') || ' --- Top Comments --- ' || title || ' --- Top Comments --- x' ELSE content END AS b FROM {ITEMS} WHERE title IS NOT NULL AND content IS NOT NULL), p AS (SELECT id, b, instr(b, '--- Top Comments ---') AS k FROM b)
SELECT id, {_STRIP.format("CASE WHEN k > 0 THEN substr(b, 1, k - 1) ELSE b END")} AS main, CASE WHEN k > 0 THEN {_STRIP.format("substr(b, k + 20)")} ELSE '' END AS comments FROM p""")
def comment_marker_split(spark: SparkSession, sf: str) -> DataFrame:
    b = F.when(F.length("id") % 2 == 0, F.concat(F.coalesce("content", F.lit("")), F.lit(" --- Top Comments --- "), F.col("title"), F.lit(" --- Top Comments --- x"))).otherwise(F.col("content"))
    main, comments = P.comments_apart(F.col("b"))
    return items(spark, sf, "content", "title").where("title IS NOT NULL AND content IS NOT NULL").select("id", b.alias("b")).select("id", main.alias("main"), comments.alias("comments"))


@query(f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?m){P.HEADING}')) AS p, generate_subscripts(regexp_split_to_array(text, '(?m){P.HEADING}'), 1) AS i, regexp_extract_all(text, '(?m){P.HEADING}', 1) AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN i = 1 THEN 'overview' ELSE h[i - 1] END AS title, length({_STRIP.format("p")}) AS chars FROM p WHERE {_STRIP.format("p")} <> ''""")
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(P.markdown_sections(F.col("text"))).alias("s"))
    return d.select("doc_id", "s.title", F.length("s.body").cast("bigint").alias("chars"))


_REPLY = "CASE length(id) % 4 WHEN 0 THEN metadata WHEN 1 THEN 'Sure: ```json' || chr(10) || metadata || chr(10) || '``` done' WHEN 2 THEN 'The answer is ' || metadata || ' as asked.' ELSE '```' || metadata || '```' END"


@query(f"""WITH r AS (SELECT id, {_REPLY} AS r FROM {ITEMS} WHERE metadata IS NOT NULL), c AS (SELECT id, [r, regexp_extract(r, '(?s)```(?:json)?\\s*(.*?)```', 1), regexp_extract(r, '(?s)\\{{.*\\}}')] AS c FROM r),
o AS (SELECT id, list_filter(c, lambda x: json_valid(x) AND regexp_matches(x, '(?s)^\\s*\\{{.*\\}}\\s*$'))[1] AS o FROM c) SELECT id, json_extract_string(o, '$.category') AS category, o IS NOT NULL AS parsed FROM o""")
def lenient_json(spark: SparkSession, sf: str) -> DataFrame:
    """A model's reply as JSON, however it is wrapped; null where no strategy finds an object."""
    n, m = F.length("id") % 4, F.col("metadata")
    r = F.when(n == 0, m).when(n == 1, F.concat(F.lit("Sure: ```json\n"), m, F.lit("\n``` done"))).when(n == 2, F.concat(F.lit("The answer is "), m, F.lit(" as asked."))).otherwise(F.concat(F.lit("```"), m, F.lit("```")))
    d = items(spark, sf, "metadata").where("metadata IS NOT NULL").select("id", P.lenient_json(r).alias("o"))
    return d.select("id", F.get_json_object("o", "$.category").alias("category"), F.col("o").isNotNull().alias("parsed"))


_ENTRIES = "SELECT item_id, collected_at, source_run, map_entries(metrics) AS e FROM (SELECT DISTINCT item_id, collected_at, source_run, metrics FROM engagement_snapshots WHERE metrics IS NOT NULL)"


@query(f"WITH e AS ({_ENTRIES}) SELECT item_id, collected_at, '{{' || array_to_string(list_transform(list_sort(e), lambda x: '\"' || x.key || '\":' || coalesce(CAST(x.value AS VARCHAR), 'null')), ',') || '}}' AS canonical FROM e")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "engagement_snapshots").where("metrics IS NOT NULL").select("item_id", "collected_at", "source_run", P.canonical_map(F.col("metrics")).alias("canonical")).distinct()
    return d.select("item_id", "collected_at", "canonical")


@query(f"WITH e AS ({_ENTRIES}) SELECT item_id, collected_at, array_to_string(list_transform(list_sort(e), lambda x: x.key || '=' || CASE WHEN regexp_matches(x.key, 'views') AND x.value IS NOT NULL THEN '***' ELSE coalesce(CAST(x.value AS VARCHAR), '') END), ';') AS safe FROM e")
def secret_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Values whose key names a secret (here: views) come out as stars."""
    m = F.array_sort(F.map_entries(P.redacted(F.col("metrics"), "views")))
    d = load(spark, sf, "engagement_snapshots").where("metrics IS NOT NULL").select("item_id", "collected_at", "source_run", F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";").alias("safe")).distinct()
    return d.select("item_id", "collected_at", "safe")


@query(f"WITH e AS ({_ENTRIES}) SELECT item_id, collected_at, array_to_string(list_transform(list_sort(list_filter(e, lambda x: x.key IN ('likes', 'replies') AND x.value IS NOT NULL)), lambda x: x.key || '=' || x.value), ';') AS kept FROM e")
def metadata_projection(spark: SparkSession, sf: str) -> DataFrame:
    m = F.array_sort(F.map_entries(P.projected(F.col("metrics"), ["likes", "replies"])))
    d = load(spark, sf, "engagement_snapshots").where("metrics IS NOT NULL").select("item_id", "collected_at", "source_run", F.col("metrics"), F.array_join(F.transform(m, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("kept"))
    return d.select("item_id", "collected_at", "source_run", P.canonical_map(F.col("metrics")).alias("c"), "kept").distinct().select("item_id", "collected_at", "kept")


@query(f"""WITH w AS (SELECT id, title, list_filter(regexp_extract_all(regexp_replace(title, '{P.FILLER_ZH}', ' ', 'g'), '{P.WORDS.replace("IsLatin", "Latin")}'), lambda w: lower(w) NOT IN {P.FILLER}) AS w FROM {ITEMS} WHERE title IS NOT NULL),
d AS (SELECT id, title, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM w) SELECT id, array_to_string(w[1:8], ' ') AS words, nullif(regexp_extract(title, '(?:19|20)\\d{{2}}'), '') AS year FROM d""")
def query_clean(spark: SparkSession, sf: str) -> DataFrame:
    words, year = P.clean_query(F.col("title"))
    return items(spark, sf, "title").where("title IS NOT NULL").select("id", words.alias("words"), year.alias("year"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'browser' WHEN doc_id % 5 = 0 THEN 'search' WHEN doc_format = 'rss' THEN 'feed' WHEN doc_format = 'html' THEN 'page' ELSE 'snapshot' END AS mode FROM documents")
def mode_inference(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(F.col("doc_id") % 5 == 0, "https://a.example/?q={query}").otherwise(F.coalesce("url", F.lit("")))
    return load(spark, sf, "documents").select("doc_id", P.retrieval_mode(F.col("doc_id") % 7 == 0, url, F.col("doc_format")).alias("mode"))


@query("SELECT doc_id, 'https://a.example/s?q=' || replace(url_encode(coalesce(source, '')), '%20', '+') || '&page=' || (doc_id % 9) || '&x=' AS url FROM documents")
def url_templating(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", P.fill_url("https://a.example/s?q={query}&page={page}&x={unknown}", query=F.coalesce("source", F.lit("")), page=F.col("doc_id") % 9).alias("url"))


@query("""SELECT doc_id, CASE WHEN e IS NOT NULL THEN 'error' WHEN regexp_matches(low, 'captcha|are you human|验证码') AND NOT b THEN 'blocked_captcha' WHEN regexp_matches(low, 'sign in|log in|请登录|permission') AND NOT b THEN 'blocked_auth' WHEN st BETWEEN 200 AND 299 AND regexp_matches(low, '"error_code"\\s*:\\s*"?\\d+') AND NOT b THEN 'signed_required'
 WHEN st BETWEEN 200 AND 299 AND b THEN 'pass' WHEN st BETWEEN 200 AND 299 THEN 'list_only' ELSE 'error' END AS verdict FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'timeout' END AS e, CASE WHEN doc_id % 13 = 0 THEN 404 ELSE 200 END AS st, lower(coalesce(t, '')) AS low, coalesce(length(t) >= 200, false) AS b FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Are you human?' WHEN 1 THEN 'Please log in' WHEN 2 THEN '{"error_code": 12}' ELSE text END AS t FROM documents))""")
def reachability_probe(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id") % 6
    t = F.when(n == 0, "Are you human?").when(n == 1, "Please log in").when(n == 2, '{"error_code": 12}').otherwise(F.coalesce("text", F.lit("")))
    return load(spark, sf, "documents").select("doc_id", P.reachable(F.when(F.col("doc_id") % 13 == 0, 404).otherwise(200), t, F.when(F.col("doc_id") % 11 == 0, "timeout")).alias("verdict"))


@query(f"SELECT source_type, count(*) AS n FROM {ITEMS} WHERE published_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 720 HOUR AND published_at < TIMESTAMPTZ '{NOW}+00' GROUP BY source_type")
def time_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the last hours before a pinned time; the bounds reach the scan."""
    now = F.lit(NOW).cast("timestamp")
    return items(spark, sf, "source_type", "published_at").where((F.col("published_at") >= now - F.expr("INTERVAL 720 HOURS")) & (F.col("published_at") < now)).groupBy("source_type").agg(F.count("*").alias("n"))


@query(f"SELECT id, CASE WHEN published_at IS NULL THEN 'undated' WHEN published_at > TIMESTAMPTZ '{NOW}+00' THEN strftime(published_at, '%Y-%m-%d') WHEN epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(published_at) < 3600000000 THEN 'now' WHEN epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(published_at) < 86400000000 THEN CAST((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(published_at)) // 3600000000 AS VARCHAR) || ' h' WHEN epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(published_at) < 604800000000 THEN CAST((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(published_at)) // 86400000000 AS VARCHAR) || ' d' ELSE strftime(published_at, '%Y-%m-%d') END AS shown FROM {ITEMS}")
def date_display(spark: SparkSession, sf: str) -> DataFrame:
    """How a date is shown against a pinned time: hours, days, then the day itself."""
    now = F.lit(NOW).cast("timestamp")
    age = F.unix_micros(now) - F.unix_micros("published_at")
    day = F.date_format("published_at", "yyyy-MM-dd")
    whole = lambda unit: F.floor(age / unit).cast("bigint").cast("string")
    shown = F.when(F.col("published_at").isNull(), "undated").when(F.col("published_at") > now, day).when(age < 3600000000, "now").when(age < 86400000000, F.concat(whole(3600000000), F.lit(" h"))).when(age < 604800000000, F.concat(whole(86400000000), F.lit(" d"))).otherwise(day)
    return items(spark, sf, "published_at").select("id", shown.alias("shown"))


@query("WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, s, len(list_filter(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x))) + 2 * (i - 1) <= 600)) AS k FROM s) SELECT doc_id, array_to_string(s[1:k], chr(10) || chr(10)) AS head FROM k")
def segment_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", P.whole_segments(F.col("text"), 600).alias("head"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\[([^\]\n]+)\]\((https?://[^)\s]+)\)', 1)) AS label, unnest(regexp_extract_all(text, '\[([^\]\n]+)\]\((https?://[^)\s]+)\)', 2)) AS url FROM documents WHERE text IS NOT NULL")
def rows_by_declared_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a page by a declared pattern with one group per field."""
    pat = F.lit("\\[([^\\]\\n]+)\\]\\((https?://[^)\\s]+)\\)")
    both = F.arrays_zip(F.regexp_extract_all("text", pat, F.lit(1)).alias("label"), F.regexp_extract_all("text", pat, F.lit(2)).alias("url"))
    return load(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(both).alias("r")).select("doc_id", "r.label", "r.url")


@query(f"SELECT source_type, count(*) FILTER (WHERE contains(lower(concat_ws(' ', title, content)), 'council') AND contains(lower(concat_ws(' ', title, content)), 'licence')) AS kept, count(*) FILTER (WHERE NOT (contains(lower(concat_ws(' ', title, content)), 'council') AND contains(lower(concat_ws(' ', title, content)), 'licence'))) AS dropped FROM {ITEMS} GROUP BY source_type")
def phrase_gate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What a phrase lets through from each source, and what it drops, counted."""
    low = F.lower(F.concat_ws(" ", "title", "content"))
    ok = F.contains(low, F.lit("council")) & F.contains(low, F.lit("licence"))
    return items(spark, sf, "source_type", "title", "content").groupBy("source_type").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query(f"""WITH q AS (SELECT doc_id AS q, list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 3) AS w FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL), x AS (SELECT q, list_distinct(w) AS w, list_filter(w, lambda t: length(t) = list_max(list_transform(w, lambda y: length(y))))[1] AS longest FROM q WHERE len(w) > 0),
u AS (SELECT q, len(w) AS n, longest, unnest(w) AS word FROM x), d AS (SELECT DISTINCT id, unnest(string_split(lower(coalesce(title, '') || ' ' || coalesce(content, '')), ' ')) AS word FROM {ITEMS}),
h AS (SELECT q, id, any_value(n) AS n, count(*) AS c, max(CAST(word = longest AS INT)) AS l FROM u JOIN d USING (word) GROUP BY q, id), g AS (SELECT q, count(*) FILTER (WHERE c = n) AS every, count(*) FILTER (WHERE l = 1) AS one FROM h GROUP BY q)
SELECT x.q, CASE WHEN coalesce(every, 0) > 0 THEN 'all' ELSE 'longest' END AS mode, CASE WHEN coalesce(every, 0) > 0 THEN every ELSE coalesce(one, 0) END AS hits FROM x LEFT JOIN g USING (q)""")
def search_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    """Each query by all its words; where nothing holds them all, by its longest word alone. The queries are every 20th document's title; one plan for all."""
    w = F.filter(F.split(F.lower("title"), " "), lambda t: F.length(t) >= 3)
    x = load(spark, sf, "documents").where("doc_id % 20 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("q"), w.alias("w")).where(F.size("w") > 0)
    first = F.aggregate("w", F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    x = x.select("q", F.array_distinct("w").alias("w"), first.alias("longest"))
    d = items(spark, sf, "title", "content").select("id", F.array_distinct(F.split(F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))), " ")).alias("terms"))

    def find(block: Postings, rows: pa.Table) -> pa.Table:
        every = [len(block.all_of(t)) for t in block.lists]
        one = [len(block.of(t[k])) for t, k in zip(block.lists, rows.column("at").to_pylist())]
        return pa.table({"q": rows.column("q"), "every": pa.array(every, pa.int64()), "one": pa.array(one, pa.int64())})

    lists = x.select("q", F.col("w").alias("terms"), (F.array_position("w", F.col("longest")) - 1).alias("at"))
    g = per_block(d, load(spark, sf, "corpus_items").count(), lists, find, "q bigint, every bigint, one bigint").where("one > 0").groupBy("q").agg(F.sum("every").alias("every"), F.sum("one").alias("one"))
    z = x.select("q").join(g, "q", "left").fillna(0)
    return z.select("q", F.when(F.col("every") > 0, "all").otherwise("longest").alias("mode"), F.when(F.col("every") > 0, F.col("every")).otherwise(F.col("one")).alias("hits"))


_L = 7


@query(f"""WITH b AS (SELECT id, title, trust, lower(coalesce(title, '')) AS lt, lower(coalesce(content, '')) AS lc FROM {ITEMS}),
p AS (SELECT id, lt, 0 AS pool, row_number() OVER (ORDER BY length(lt || lc) - length(replace(lt || lc, 'council', '')) DESC, id) AS pos FROM b WHERE contains(lt || lc, 'council') QUALIFY pos <= {max(20 * _L, 120)}),
q AS (SELECT id, lt, 1 AS pool, row_number() OVER (ORDER BY trust DESC NULLS LAST, id) AS pos FROM b WHERE contains(lc, 'council') QUALIFY pos <= {max(15 * _L, 90)}), r AS (SELECT id, lt, 2 AS pool, row_number() OVER (ORDER BY length(lt), id) AS pos FROM b WHERE contains(lt, 'council') QUALIFY pos <= {max(10 * _L, 60)}),
u AS (SELECT * FROM p UNION ALL SELECT * FROM q UNION ALL SELECT * FROM r) SELECT id, pool, pos FROM u QUALIFY row_number() OVER (PARTITION BY substr(lt, 1, 80) ORDER BY pool, pos, id) = 1""")
def candidate_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Three pools (by occurrences, bodies by trust, titles by length), their sizes grown with the number wanted; the first sighting of a title wins."""
    lt, lc = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    d = items(spark, sf, "title", "content", "trust").select("id", "trust", lt.alias("lt"), lc.alias("lc"))
    both = F.concat("lt", "lc")
    tf = F.length(both) - F.length(F.replace(both, F.lit("council"), F.lit("")))

    def pool(no: int, rows: DataFrame, order: list, n: int) -> DataFrame:
        top = rows.orderBy(*order).limit(n)  # a top-k, so its window sees n rows
        return top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint")).select("id", "lt", F.lit(no).alias("pool"), "pos")

    a = pool(0, d.where(F.contains(both, F.lit("council"))), [F.desc(tf), F.col("id")], max(20 * _L, 120))
    b = pool(1, d.where(F.contains(F.col("lc"), F.lit("council"))), [F.desc_nulls_last("trust"), F.col("id")], max(15 * _L, 90))
    c = pool(2, d.where(F.contains(F.col("lt"), F.lit("council"))), [F.length("lt"), F.col("id")], max(10 * _L, 60))
    u = a.unionByName(b).unionByName(c)
    first = u.groupBy(F.substring("lt", 1, 80).alias("k")).agg(F.min(F.struct("pool", "pos", "id")).alias("r"))
    return first.select("r.id", "r.pool", "r.pos")
