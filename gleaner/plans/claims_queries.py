"""Claims and evidence: terms, anchors, links, statements, gates and digests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import claims as C
from gleaner.operators import trust
from gleaner.plans.relational_queries import _VOTES, _votes
from gleaner.plans.text_queries import ITEMS, items, load
from gleaner.session import cut, values

QUERIES: dict = {}
ORACLES: dict = {}
TERMS = [("60",), ("safe",), ("licence",), ("预算",), ("museum",), ("turbine",), ("3.2",)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_H = "\\x{4e00}-\\x{9fff}"
_STOP = "(" + ", ".join(f"'{w}'" for w in C.STOP) + ")"


def _pen(g: str) -> str:
    return f"(length({g}) - length(regexp_replace({g}, '[{C.FUNCTION_CHARS}]', '', 'g')))"


def sql_terms(text: str) -> str:
    return f"""list_filter(flatten(list_transform(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9_.+#-]*|[{_H}]+'), lambda w: CASE WHEN NOT regexp_matches(w, '^[{_H}]') OR length(w) <= 2 THEN [w]
 ELSE list_concat(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) END)),
 lambda g: length(g) >= 2 AND g NOT IN {_STOP} AND {_pen("g")} <= CASE WHEN length(g) = 2 THEN 1 ELSE 2 END)"""


_CANDIDATES = f"SELECT id, term, min(pos) AS pos FROM (SELECT id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT id, {sql_terms('title')} AS ts FROM {ITEMS})) GROUP BY id, term"


@query(f"WITH c AS ({_CANDIDATES}) SELECT id, string_agg(term, ' ' ORDER BY pos) AS terms, count(*) AS n FROM c GROUP BY id")
def claim_terms_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "title").select("id", C.term_candidates(F.col("title")).alias("t")).where(F.size("t") > 0)
    return d.select("id", F.array_join("t", " ").alias("terms"), F.size("t").cast("bigint").alias("n"))


_DISCRIMINATING = f"""c AS ({_CANDIDATES}), df AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest({sql_terms("coalesce(title, '') || ' ' || coalesce(content, '')")}) AS term FROM {ITEMS}) GROUP BY term),
n AS (SELECT count(*) AS n FROM {ITEMS}),
r AS (SELECT id, list(term ORDER BY (coalesce(df, 0) = 0), {_pen("term")}, coalesce(df, 0) > greatest(2, n // 5), -coalesce(df, 0), -length(term), pos, term) AS r FROM c LEFT JOIN df USING (term), n GROUP BY id),
d AS (SELECT id, list_reduce(r, lambda a, x: CASE WHEN len(a) >= 4 OR len(list_filter(a, lambda t: contains(t, x[1]) OR contains(x[1], t))) > 0 THEN a ELSE list_concat(a, x) END, []::VARCHAR[]) AS terms FROM (SELECT id, list_transform(r, lambda t: [t]) AS r FROM r))"""


def _discriminating(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "title", "content")
    dfs = C.document_frequency(d.select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("blob")), "id", "blob")
    return C.discriminating(d, "id", "title", dfs, d.count())


@query(f"WITH {_DISCRIMINATING} SELECT id, array_to_string(terms, ' | ') AS terms FROM d WHERE len(terms) > 0")
def discriminating_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _discriminating(spark, sf).where(F.size("terms") > 0).select("id", F.array_join("terms", " | ").alias("terms"))


_BLOB = "lower(concat_ws(' ', coalesce(title, ''), coalesce(content, '')))"
_WORD = "(contains(blob, term) AND (regexp_matches(term, '^[" + _H + "]') OR regexp_matches(' ' || blob || ' ', '[^0-9a-z]' || regexp_escape(term) || '[^0-9a-z]')))"
_CLAIM_SQL = f"""dq AS (SELECT doc_id AS id, title FROM documents WHERE doc_id % 20 = 0),
c AS (SELECT id, term, min(pos) AS pos FROM (SELECT id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT id, {sql_terms("title")} AS ts FROM dq)) GROUP BY id, term),
df AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest({sql_terms("coalesce(title, '') || ' ' || coalesce(content, '')")}) AS term FROM {ITEMS}) GROUP BY term), n AS (SELECT count(*) AS n FROM {ITEMS}),
r AS (SELECT id, list(term ORDER BY (coalesce(df, 0) = 0), {_pen("term")}, coalesce(df, 0) > greatest(2, n // 5), -coalesce(df, 0), -length(term), pos, term) AS r FROM c LEFT JOIN df USING (term), n GROUP BY id),
d AS (SELECT id, list_reduce(r, lambda a, x: CASE WHEN len(a) >= 4 OR len(list_filter(a, lambda t: contains(t, x[1]) OR contains(x[1], t))) > 0 THEN a ELSE list_concat(a, x) END, []::VARCHAR[]) AS terms FROM (SELECT id, list_transform(r, lambda t: [t]) AS r FROM r)),
w AS (SELECT id AS claim_id, len(terms) AS n, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM d),
po AS (SELECT DISTINCT item_id, blob, term FROM (SELECT id AS item_id, {_BLOB} AS blob, unnest({sql_terms(_BLOB)}) AS term FROM {ITEMS}) WHERE term IN (SELECT term FROM w)),
h AS (SELECT claim_id, item_id, any_value(n) AS n, count(*) AS shared, count(*) FILTER (WHERE pos < 3) AS s3, count(*) FILTER (WHERE pos < 2) AS s2, max(CAST(pos < 2 AND {_WORD} AS INT)) AS anchored FROM w JOIN po USING (term) GROUP BY claim_id, item_id),
l AS (SELECT *, CASE WHEN shared = n THEN 1 WHEN s3 = least(n, 3) THEN 2 WHEN s2 = least(n, 2) THEN 3 END AS level FROM h),
k AS (SELECT *, min(level) OVER (PARTITION BY claim_id) AS best FROM l WHERE level IS NOT NULL)"""


def _claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Claims: titles of documents whose number divides by 20; evidence: all items."""
    d = cut(items(spark, sf, "title", "content"), "evidence")  # replayed rows are found once, not once a use
    dfs = C.document_frequency(d.select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("blob")), "id", "blob", unique=True)
    q = load(spark, sf, "documents").where("doc_id % 20 = 0").select("doc_id", "title")
    c = C.discriminating(q, "doc_id", "title", dfs, d.count()).select(F.col("doc_id").alias("claim_id"), "terms", F.lit(None).cast("string").alias("origin"))
    return c, d.select(F.col("id").alias("item_id"), "title", "content")


@query(f"WITH {_CLAIM_SQL} SELECT claim_id, item_id, level, shared, row_number() OVER (PARTITION BY claim_id ORDER BY shared DESC, item_id) AS place FROM k WHERE level <= best AND anchored = 1 QUALIFY place <= 8")
def link_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of each claim among all items: all terms, else three, else two, and an anchor term as a word."""
    c, d = _claims(spark, sf)
    return C.link_evidence(c, d).select("claim_id", "item_id", F.col("level").cast("int").alias("level"), "shared", F.col("place").cast("bigint").alias("place"))


@query("WITH t(term) AS (VALUES ('60'), ('safe'), ('licence'), ('预算'), ('museum'), ('turbine'), ('3.2')), b AS (SELECT doc_id, lower(concat_ws(' ', coalesce(title, ''), coalesce(text, ''))) AS blob FROM documents) SELECT doc_id, term FROM b, t WHERE " + _WORD)
def anchor_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that mention an anchor as a word (Latin) or at all (Han); the anchors are few."""
    b = load(spark, sf, "documents").select("doc_id", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("blob"))
    terms = F.array(*[F.lit(t) for (t,) in TERMS])
    return b.select("doc_id", F.explode(F.filter(terms, lambda t: C.mentions(t, F.col("blob")))).alias("term"))


@query("SELECT id, CAST(list_bool_or(list_transform(['Works', 'Labs', 'council', '研究院'], lambda t: contains(coalesce(title, '') || ' ' || substr(coalesce(content, ''), 1, 400), t))) AS BOOLEAN) AS about FROM " + ITEMS)
def false_positive_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether title and opening hold any of the subject's terms, case told apart."""
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("content", F.lit("")), 1, 400))
    hit = F.exists(F.array(*[F.lit(t) for t in ("Works", "Labs", "council", "研究院")]), lambda t: F.contains(blob, t))
    return items(spark, sf, "title", "content").select("id", hit.alias("about"))


_STATEMENT = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query(f"""WITH s AS (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '[.!?。！？\\n]+'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 6) AS s FROM {ITEMS} WHERE content IS NOT NULL),
g AS (SELECT id, list_transform(s, lambda s: {_STATEMENT.format("s")}) AS k FROM s),
b AS (SELECT id, list_transform(k, lambda t: CASE WHEN length(t) >= 2 THEN list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) WHEN length(t) = 1 THEN [t] ELSE []::VARCHAR[] END) AS b, k FROM g),
r AS (SELECT id, list_reduce(list_transform(range(1, len(k) + 1), lambda i: [i]), lambda a, x: CASE WHEN len(a) >= 12 OR len(list_filter(a, lambda j: k[j] = k[x[1]] OR (len(b[j]) > 0 AND len(b[x[1]]) > 0 AND len(list_intersect(b[j], b[x[1]])) >= 0.85 * least(len(b[j]), len(b[x[1]]))))) > 0 THEN a ELSE list_concat(a, x) END, []::BIGINT[]) AS kept FROM b)
SELECT id, len(kept) AS statements FROM r""")
def claim_extraction_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """How many different statements of six characters or more each item makes, twelve at most, as claims are drawn from it."""
    d = items(spark, sf, "content").where("content IS NOT NULL")
    return d.select("id", F.size(C.distinct_statements(F.split("content", "[.!?。！？\\n]+"))).cast("bigint").alias("statements"))


@query(f"SELECT id, concat_ws(':', id, '0', regexp_replace(substr(regexp_replace(lower(title), '[^0-9a-z{_H}]+', '-', 'g'), 1, 32), '^-|-$', '', 'g')) AS claim_id FROM {ITEMS} WHERE title IS NOT NULL")
def claim_slug_id(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf, "title").where("title IS NOT NULL").select("id", C.slug(F.col("id"), F.lit(0), F.col("title")).alias("claim_id"))


@query("""WITH c AS (SELECT l_linestatus AS status, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS verdict, CASE l_suppkey % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'trust_gate' END AS source, l_linenumber AS independent FROM lineitem)
SELECT 'status' AS kind, status AS label, count(*) AS n FROM c GROUP BY status UNION ALL SELECT 'verdict', verdict, count(*) FROM c WHERE verdict IS NOT NULL GROUP BY verdict
UNION ALL SELECT 'verdict_source', coalesce(source, 'unset'), count(*) FROM c WHERE verdict IS NOT NULL GROUP BY coalesce(source, 'unset') UNION ALL SELECT 'multi_source', 'all', count(*) FROM c WHERE independent >= 2""")
def claim_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by status, by verdict and by who gave it (one pass: grouping sets over the three labels)."""
    src = F.when(F.col("l_suppkey") % 3 == 0, "model").when(F.col("l_suppkey") % 3 == 1, "trust_gate")
    c = load(spark, sf, "lineitem").select(F.col("l_linestatus").alias("status"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("verdict"), F.coalesce(src, F.lit("unset")).alias("source"), (F.col("l_linenumber") >= 2).alias("multi"))
    per = c.groupBy("status", "verdict", "source", "multi").agg(F.count("*").alias("c"))  # everything below works on this small table
    lab = F.array(
        F.struct(F.lit("status").alias("kind"), F.col("status").alias("label")), F.struct(F.when(F.col("verdict").isNotNull(), "verdict").alias("kind"), F.col("verdict").alias("label")),
        F.struct(F.when(F.col("verdict").isNotNull(), "verdict_source").alias("kind"), F.col("source").alias("label")), F.struct(F.when(F.col("multi"), "multi_source").alias("kind"), F.lit("all").alias("label")),
    )
    return per.select("c", F.explode(lab).alias("x")).where("x.kind IS NOT NULL").groupBy(F.col("x.kind").alias("kind"), F.col("x.label").alias("label")).agg(F.sum("c").alias("n"))


_GATE = "CASE WHEN coalesce(confidence, 0) >= 0.55 AND (families >= 2 OR (families = 1 AND publishers >= 3 AND prior >= 0.40)) THEN 'supported' ELSE 'unsupported' END"
_MODEL = "CASE day(claim) % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' END"


@query("WITH " + _VOTES + f""", al AS (SELECT DISTINCT claim FROM v0), pr AS (SELECT claim, max(p.prior) AS prior FROM dv JOIN publishers p USING (publisher) GROUP BY claim), g AS (SELECT claim, {_MODEL} AS model, {_GATE} AS gate FROM al LEFT JOIN nor USING (claim) LEFT JOIN pr USING (claim))
SELECT claim, CASE WHEN model = 'supported' AND gate <> 'supported' THEN 'unsupported' ELSE model END AS verdict, CASE WHEN model = 'supported' AND gate <> 'supported' THEN 'trust_gate' WHEN model IS NOT NULL THEN 'model' END AS verdict_source FROM g""")
def demote_only_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A model's verdict of each claim (here by its day) after the arithmetic gate, which may only demote."""
    v = _votes(spark, sf)
    c = trust.collapse_votes(v, "claim")
    prior = c.join(F.broadcast(load(spark, sf, "publishers").select("publisher", "prior")), "publisher").groupBy("claim").agg(F.max("prior").alias("prior"))  # a fixed dimension of 72 rows
    a = v.select("claim").distinct().join(trust.noisy_or(c, "claim"), "claim", "left").join(prior, "claim", "left")
    gate = trust.verdict(F.coalesce("confidence", F.lit(0.0)), F.col("families"), F.col("publishers"), F.col("prior"))
    model = F.when(F.dayofmonth("claim") % 3 == 0, "supported").when(F.dayofmonth("claim") % 3 == 1, "unsupported")
    verdict, source = C.demote(model, gate)
    return a.select("claim", verdict.alias("verdict"), source.alias("verdict_source"))


@query("SELECT item_id, string_agg(platform || '=' || n, ';' ORDER BY platform) AS verdicts FROM (SELECT item_id, platform, count(*) AS n FROM engagement_snapshots GROUP BY item_id, platform) GROUP BY item_id")
def verdict_map_per_item(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of each item, by who says it, as a map written out in order (one entry a platform, pre-aggregated)."""
    d = load(spark, sf, "engagement_snapshots").groupBy("item_id", "platform").agg(F.count("*").alias("n"))
    m = d.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "n")))).alias("m"))
    return m.select("item_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("verdicts"))


@query(f"SELECT id, coalesce(time_basis, 'pending') AS verdict, trust FROM {ITEMS} ORDER BY CASE WHEN time_basis IS NULL THEN 1 ELSE 0 END, trust DESC NULLS LAST, id LIMIT 12")
def report_verdict_digest(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "time_basis", "trust")
    return d.orderBy(F.col("time_basis").isNull().cast("int"), F.desc_nulls_last("trust"), "id").limit(12).select("id", F.coalesce("time_basis", F.lit("pending")).alias("verdict"), "trust")


@query("WITH t(term) AS (VALUES ('60'), ('safe'), ('licence'), ('预算'), ('museum'), ('turbine'), ('3.2')) SELECT term, count(*) FILTER (WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(content, '')), term)) AS df FROM t, " + ITEMS + " GROUP BY term")
def substring_df(spark: SparkSession, sf: str) -> DataFrame:
    """In how many items each given term stands, anywhere: one pass, one counter a term."""
    blob = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))
    hits = items(spark, sf, "title", "content").select(F.explode(F.filter(F.array(*[F.lit(t) for (t,) in TERMS]), lambda t: F.contains(blob, t))).alias("term"))
    return F.broadcast(values(spark, TERMS, "term string")).join(hits.groupBy("term").agg(F.count("*").alias("df")), "term", "left").fillna(0, ["df"])


@query("""WITH v AS (SELECT l_orderkey AS claim, l_suppkey AS pub, l_returnflag AS f FROM lineitem), g AS (SELECT claim, count(DISTINCT pub) AS publishers, bool_or(f = 'A') AND bool_or(f = 'R') AS contradicted, count(DISTINCT f) AS families FROM v GROUP BY claim)
SELECT claim, CASE WHEN contradicted THEN 'contested' WHEN publishers >= 3 AND families >= 2 THEN 'supported' ELSE 'unsupported' END AS verdict FROM g""")
def contested_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence on both sides makes a claim contested, whatever its count of voices."""
    f = F.col("l_returnflag")
    g = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg(F.countDistinct("l_suppkey").alias("p"), (F.bool_or(f == "A") & F.bool_or(f == "R")).alias("x"), F.countDistinct(f).alias("fam"))
    return g.select("claim", F.when(F.col("x"), "contested").when((F.col("p") >= 3) & (F.col("fam") >= 2), "supported").otherwise("unsupported").alias("verdict"))
