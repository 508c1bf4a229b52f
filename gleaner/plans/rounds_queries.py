"""Rounds, evidence over time, logs, drafts, caches and reports, with their SQL. Runs are the rounds, items the evidence, snapshots its observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators import claims as C
from gleaner.operators import rounds as R
from gleaner.plans.text_queries import ITEMS, items, load

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_RED = f"rd AS (SELECT id AS object_id, min(id) OVER (PARTITION BY cluster_id) AS canonical_id FROM {ITEMS} WHERE cluster_id IS NOT NULL)"
_LATEST = f"""{_RED}, e AS (SELECT coalesce(rd.canonical_id, i.id) AS canonical_id, i.source_type AS level, i.id AS object_id, r.id AS round_id, s.collected_at AS observed_at FROM {ITEMS} i JOIN runs r ON r.id = i.run_id
 JOIN (SELECT DISTINCT item_id, collected_at FROM engagement_snapshots) s ON s.item_id = i.id LEFT JOIN rd ON rd.object_id = i.id WHERE {{}})
SELECT canonical_id, level, object_id, round_id, observed_at FROM e QUALIFY row_number() OVER (PARTITION BY canonical_id, level ORDER BY observed_at DESC, round_id DESC, object_id DESC) = 1"""


def _evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = items(spark, sf, "run_id", "source_type", "cluster_id")
    red = d.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.min("id").alias("canonical_id"))
    red = d.join(red, "cluster_id").select(F.col("id").alias("object_id"), "canonical_id")
    obs = load(spark, sf, "engagement_snapshots").select(F.col("item_id").alias("object_id"), F.col("collected_at").alias("observed_at")).distinct()
    return d.select(F.col("run_id").alias("round_id"), F.col("id").alias("object_id"), F.col("source_type").alias("level")), obs, red


@query("WITH " + _LATEST.format("r.finished_at IS NOT NULL"))
def latest_evidence_history(spark: SparkSession, sf: str) -> DataFrame:
    """The latest observation of each object, through redirects, from rounds that are not running."""
    e, obs, red = _evidence(spark, sf)
    done = load(spark, sf, "runs").where("finished_at IS NOT NULL").select(F.col("id").alias("round_id"))
    return R.latest_evidence(e, obs, red, done)


@query("WITH " + _LATEST.format("r.finished_at IS NOT NULL AND r.id < 40 AND i.source_type IN ('v2ex', 'hackernews', 'reddit', 'github')"))
def pending_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of earlier rounds whose discussions may be read on, latest state of each."""
    e, obs, red = _evidence(spark, sf)
    done = load(spark, sf, "runs").where("finished_at IS NOT NULL AND id < 40").select(F.col("id").alias("round_id"))
    return R.latest_evidence(e.where(F.col("level").isin("v2ex", "hackernews", "reddit", "github")), obs, red, done)


@query(f"SELECT i.id, (SELECT max(collected_at) FROM engagement_snapshots s WHERE s.item_id = i.id) AS seen FROM {ITEMS} i WHERE i.run_id = 5 ORDER BY seen DESC NULLS LAST, i.id LIMIT 50")
def references_by_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    """A round's references ordered by when they were last seen: an aggregate and a join in place of a correlated subquery."""
    d = items(spark, sf, "run_id").where("run_id = 5").select("id")
    seen = load(spark, sf, "engagement_snapshots").groupBy(F.col("item_id").alias("id")).agg(F.max("collected_at").alias("seen"))
    return d.join(seen, "id", "left").orderBy(F.desc_nulls_last("seen"), "id").limit(50)


@query(f"WITH s AS (SELECT item_id, arg_max(source_run, (collected_at, source_run)) FILTER (WHERE source_run IS NOT NULL) AS origin FROM engagement_snapshots GROUP BY item_id) SELECT i.id, coalesce(s.origin, 'run-' || i.run_id) AS origin FROM {ITEMS} i LEFT JOIN s ON s.item_id = i.id")
def origin_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Where an object comes from: its latest snapshot's run, else the run that stored it."""
    s = load(spark, sf, "engagement_snapshots").where("source_run IS NOT NULL").groupBy(F.col("item_id").alias("id")).agg(F.max_by("source_run", F.struct("collected_at", "source_run")).alias("o"))
    return items(spark, sf, "run_id").join(s, "id", "left").select("id", F.coalesce("o", F.concat(F.lit("run-"), F.col("run_id").cast("string"))).alias("origin"))


@query(f"SELECT DISTINCT s.item_id, r.id AS round_id FROM engagement_snapshots s JOIN runs r ON s.source_run = 'run-' || r.id JOIN {ITEMS} i ON i.id = s.item_id WHERE r.finished_at IS NULL OR r.finished_at >= s.collected_at")
def conditional_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Observations are attached only where their round is (or was) active and the object exists."""
    r = load(spark, sf, "runs").select(F.col("id").alias("round_id"), "finished_at", F.concat(F.lit("run-"), F.col("id").cast("string")).alias("source_run"))
    s = load(spark, sf, "engagement_snapshots").select("item_id", "collected_at", "source_run").join(F.broadcast(r), "source_run")  # 60 runs
    return s.where(F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("collected_at"))).join(items(spark, sf).select(F.col("id").alias("item_id")), "item_id", "left_semi").select("item_id", "round_id").distinct()


@query("SELECT user_id AS source, event_type AS state, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p = 1 AND event_type IN ('view', 'click')")
def latest_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of each source, kept where it is still running."""
    e = load(spark, sf, "events").groupBy(F.col("user_id").alias("source")).agg(F.max_by(F.struct(F.col("event_type").alias("state"), F.col("event_id").alias("seq")), "event_id").alias("r"))
    return e.select("source", "r.state", "r.seq").where(F.col("state").isin("view", "click"))


@query("SELECT user_id AS session, max(event_id % 50) + 1 AS revision FROM events GROUP BY user_id")
def next_revision(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg((F.max(F.col("event_id") % 50) + 1).alias("revision"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 700 ORDER BY event_id LIMIT 100")
def event_log_after_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return R.after_cursor(load(spark, sf, "events").select("event_id", "event_type"), "event_id", 700, 100)


@query("SELECT event_type, kind, count(*) AS n FROM (SELECT event_type, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'append' ELSE 'refresh' END AS kind FROM events) GROUP BY ALL")
def append_or_refresh(spark: SparkSession, sf: str) -> DataFrame:
    e = R.sightings(load(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])
    return e.groupBy("event_type", "kind").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN finished_at IS NULL AND nx IS NULL THEN 'interrupted' WHEN finished_at IS NULL THEN 'cancelled' WHEN finished_at > nx THEN 'overlapped' ELSE 'done' END AS state FROM (SELECT *, lead(started_at) OVER (ORDER BY started_at, id) AS nx FROM runs)")
def crash_sweep_supersede(spark: SparkSession, sf: str) -> DataFrame:
    return R.supersede(load(spark, sf, "runs"))


_ALIAS = f"al AS (SELECT id AS object_id, 'u' || regexp_replace(url, '[?#].*$', '') AS alias FROM {ITEMS} WHERE url IS NOT NULL UNION SELECT id, 'c' || cluster_id FROM {ITEMS} WHERE cluster_id IS NOT NULL)"


@query(f"""WITH RECURSIVE {_ALIAS}, hub AS (SELECT alias, min(object_id) AS hub FROM al GROUP BY alias), ed AS (SELECT object_id AS a, hub AS b FROM al JOIN hub USING (alias) UNION SELECT hub, object_id FROM al JOIN hub USING (alias)),
re AS (SELECT a AS x, a AS y FROM ed UNION SELECT re.x, ed.b FROM re JOIN ed ON re.y = ed.a),
co AS (SELECT x, min(y) AS component FROM re GROUP BY x), se AS (SELECT x, component, fetched_at FROM co JOIN {ITEMS} i ON i.id = co.x), o AS (SELECT component, arg_min(x, (fetched_at, x)) AS canonical_id FROM se GROUP BY component)
SELECT x AS object_id, canonical_id FROM se JOIN o USING (component) WHERE x <> canonical_id""")
def alias_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects that share an address or a cluster are redirected to the oldest of them (path-compressed)."""
    d = items(spark, sf, "url", "cluster_id", "fetched_at")
    a = d.where("url IS NOT NULL").select(F.col("id").alias("object_id"), F.concat(F.lit("u"), F.regexp_replace("url", "[?#].*$", "")).alias("alias"))
    a = a.unionByName(d.where("cluster_id IS NOT NULL").select(F.col("id").alias("object_id"), F.concat(F.lit("c"), "cluster_id").alias("alias")))
    return R.alias_redirects(a, d.select(F.col("id").alias("object_id"), F.col("fetched_at").alias("first_seen")))


@query(f"""WITH c AS (SELECT id, any_value(item_id) AS item_id, max(discussion_type) AS kind, max(text) AS text, max(regexp_replace(trim(parent_id), '^#comment-', '')) AS parent FROM comments GROUP BY id)
SELECT 'reply:' || coalesce(kind, '') AS kind, id AS native_id, item_id AS thread, coalesce(parent, item_id) AS parent, substr(sha256('ver' || id || coalesce(text, '')), 1, 16) AS version_id FROM c WHERE trim(coalesce(text, '')) <> ''
UNION ALL SELECT 'item', id, id, NULL, substr(sha256('ver' || id || coalesce(content, '')), 1, 16) FROM {ITEMS} WHERE trim(coalesce(content, '')) <> ''""")
def version_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """A version of every root and of all its descendants, each with its thread and parent."""
    c = load(spark, sf, "comments").groupBy("id").agg(F.max("item_id").alias("thread"), F.max("discussion_type").alias("k"), F.max("text").alias("text"), F.max(F.regexp_replace(F.trim("parent_id"), "^#comment-", "")).alias("p"))
    vid = lambda t: F.substring(F.sha2(F.concat(F.lit("ver"), F.col("id"), F.coalesce(t, F.lit(""))), 256), 1, 16).alias("version_id")
    a = c.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.concat(F.lit("reply:"), F.coalesce("k", F.lit(""))).alias("kind"), F.col("id").alias("native_id"), "thread", F.coalesce("p", "thread").alias("parent"), vid(F.col("text")))
    i = items(spark, sf, "content").where(F.trim(F.coalesce("content", F.lit(""))) != "").select(F.lit("item").alias("kind"), F.col("id").alias("native_id"), F.col("id").alias("thread"), F.lit(None).cast("string").alias("parent"), vid(F.col("content")))
    return a.unionByName(i)


@query("""WITH o AS (SELECT event_type || (user_id % 40) AS section, max(value) AS body, bool_or(event_id % 97 = 0) AS kept FROM events WHERE event_id % 2 = 0 GROUP BY section), n AS (SELECT event_type || (user_id % 44) AS section, max(value) AS body FROM events WHERE event_id % 2 = 1 GROUP BY section)
SELECT coalesce(o.section, n.section) AS section, CASE WHEN o.body IS NOT NULL AND (coalesce(kept, false) OR n.body IS NULL) THEN o.body ELSE n.body END AS body, (o.body IS NOT NULL AND (coalesce(kept, false) OR n.body IS NULL)) AND o.body IS DISTINCT FROM n.body AS stale FROM o FULL JOIN n ON o.section = n.section""")
def draft_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two renders of a report's sections: edited or locked ones stay and are marked stale."""
    e = load(spark, sf, "events")
    sec = lambda n: F.concat("event_type", (F.col("user_id") % n).cast("string")).alias("section")
    o = e.where("event_id % 2 = 0").groupBy(sec(40)).agg(F.max("value").alias("body"), F.bool_or(F.col("event_id") % 97 == 0).alias("kept"))
    n = e.where("event_id % 2 = 1").groupBy(sec(44)).agg(F.max("value").alias("body"))
    return R.merged_draft(o, n)


@query(f"WITH k AS (SELECT id, sha256(concat_ws(chr(0), 'model', 'v1', title)) AS key FROM {ITEMS} WHERE title IS NOT NULL), c AS (SELECT DISTINCT sha256(concat_ws(chr(0), 'model', 'v1', title)) AS key FROM documents WHERE title IS NOT NULL) SELECT min(id) AS id, key FROM k WHERE key NOT IN (SELECT key FROM c) GROUP BY key")
def model_cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """The calls still to be made: one per key that no cache row answers."""
    k = lambda d: d.where("title IS NOT NULL").withColumn("key", R.cache_key(F.lit("model"), F.lit("v1"), F.col("title")))
    return k(items(spark, sf, "title")).join(k(load(spark, sf, "documents")).select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("id").alias("id")).select("id", "key")


@query(f"SELECT id, fetched_at FROM {ITEMS} ORDER BY fetched_at DESC, id LIMIT 2500")
def cache_trim_newest(spark: SparkSession, sf: str) -> DataFrame:
    """A cache past its bound keeps the newest rows (the bound is the feature)."""
    return items(spark, sf, "fetched_at").orderBy(F.desc("fetched_at"), "id").limit(2500)


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE value < 5) AS errors, round(avg(value), 6) AS avg_latency, max(value) AS max_latency, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS tokens FROM events GROUP BY event_type")
def tool_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, errors, latency and tokens of each tool."""
    e = load(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 5).alias("errors"), F.round(F.avg("value"), 6).alias("avg_latency"), F.max("value").alias("max_latency"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("tokens"))


@query(f"SELECT run_id, count(*) AS n, CASE WHEN count(*) FILTER (WHERE trim(coalesce(content, '')) <> '') = 0 THEN 'failure' WHEN count(*) FILTER (WHERE trim(coalesce(content, '')) = '') > 0 THEN 'partial' ELSE 'success' END AS status FROM {ITEMS} GROUP BY run_id")
def fetch_report(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.count_if(F.trim(F.coalesce("content", F.lit(""))) != "")
    return items(spark, sf, "run_id", "content").groupBy("run_id").agg(F.count("*").alias("n"), F.when(ok == 0, "failure").when(ok < F.count("*"), "partial").otherwise("success").alias("status"))


@query(f"""WITH t(term, q) AS (VALUES ('council', 1), ('licence', 1), ('dataset', 2), ('museo', 2)), h AS (SELECT q, term, id, row_number() OVER (PARTITION BY q, term ORDER BY length(content), id) AS rank FROM t JOIN {ITEMS} ON contains(lower(coalesce(content, '')), term))
SELECT q, id, string_agg('lexical:' || term || '#' || rank, ',' ORDER BY term) AS reasons FROM h WHERE rank <= 50 GROUP BY q, id""")
def retrieval_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Why each hit was found: the term that found it and its rank there."""
    terms = [("council", 1), ("licence", 1), ("dataset", 2), ("museo", 2)]
    hit = F.filter(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(q).alias("q")) for t, q in terms]), lambda x: F.contains(F.lower(F.coalesce("content", F.lit(""))), x["term"]))
    h = items(spark, sf, "content").select("id", F.length("content").alias("n"), F.explode(hit).alias("x")).select("id", "n", "x.term", "x.q")
    w = Window.partitionBy("q", "term").orderBy("n", "id")
    h = h.withColumn("rank", F.row_number().over(w)).where("rank <= 50")  # only each list's head: a rank limit below the window
    r = h.groupBy("q", "id").agg(F.array_sort(F.collect_list(F.struct("term", "rank"))).alias("r"))
    return r.select("q", "id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("lexical:"), x["term"], F.lit("#"), x["rank"].cast("string"))), ",").alias("reasons"))


@query("WITH w AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 40) SELECT w.rank, d.doc_id, d.title FROM w JOIN documents d USING (doc_id) ORDER BY rank")
def order_preserving_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows fetched by id, in the order of the list asked for (a top-k list)."""
    d = load(spark, sf, "documents")
    top = d.select("doc_id", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(40)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "doc_id")).cast("bigint")).select("doc_id", "rank")
    return d.select("doc_id", "title").join(F.broadcast(ranked), "doc_id").orderBy("rank").select("rank", "doc_id", "title")  # 40 rows


@query(r"""WITH t AS (SELECT doc_id, text FROM documents), ref AS (SELECT doc_id, CAST(regexp_extract(l, '^\[(\d+)\]', 1) AS INT) AS n, regexp_extract(l, 'https?://\S+') AS url FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '^\[\d+\]\s')),
r AS (SELECT doc_id, n, max(url) AS url FROM ref GROUP BY doc_id, n), c AS (SELECT DISTINCT doc_id, CAST(x AS INT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^\[\d+\]\s')), chr(10)), '\[(\d{1,4})\]', 1)) AS x FROM t)),
k AS (SELECT DISTINCT regexp_replace(url, '/$', '') AS url FROM corpus_items WHERE url IS NOT NULL), a AS (SELECT coalesce(c.doc_id, r.doc_id) AS doc_id, CASE WHEN c.n IS NULL THEN 'dangling' WHEN r.n IS NULL THEN 'ghost' WHEN k.url IS NULL THEN 'missing' ELSE 'resolved' END AS kind FROM c FULL JOIN r ON c.doc_id = r.doc_id AND c.n = r.n LEFT JOIN k ON k.url = regexp_replace(r.url, '/$', ''))
SELECT doc_id, kind, count(*) AS n FROM a GROUP BY doc_id, kind""")
def citation_audit_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Per text: citations resolved to an item, missing there, without an entry (ghosts), and entries nobody cites (dangling)."""
    lines = F.split("text", "\n")
    is_ref = lambda x: x.rlike("^\\[\\d+\\]\\s")
    d = load(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("l"))
    ref = d.select("doc_id", F.explode(F.filter("l", is_ref)).alias("x")).select("doc_id", F.regexp_extract("x", "^\\[(\\d+)\\]", 1).cast("int").alias("n"), F.regexp_extract("x", "https?://\\S+", 0).alias("u"))
    ref = ref.groupBy("doc_id", "n").agg(F.max("u").alias("u")).withColumn("in_ref", F.lit(1))
    body = F.array_join(F.filter("l", lambda x: ~is_ref(x)), "\n")
    cited = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit("\\[(\\d{1,4})\\]"), F.lit(1)))).alias("n")).select("doc_id", F.col("n").cast("int").alias("n")).distinct().withColumn("in_text", F.lit(1))
    known = load(spark, sf, "corpus_items").where("url IS NOT NULL").select(F.regexp_replace("url", "/$", "").alias("k")).distinct()
    a = cited.join(ref, ["doc_id", "n"], "full_outer").join(known, F.regexp_replace("u", "/$", "") == F.col("k"), "left")
    kind = F.when(F.col("in_text").isNull(), "dangling").when(F.col("in_ref").isNull(), "ghost").when(F.col("k").isNull(), "missing").otherwise("resolved")
    return a.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


_SECTIONS = {"money": ("price", "million", "budget", "bid"), "law": ("licence", "court", "lawsuit", "permission"), "data": ("dataset", "index", "benchmark", "model")}


@query("WITH k AS (SELECT * FROM (VALUES ('money', 'price'), ('money', 'million'), ('money', 'budget'), ('money', 'bid'), ('law', 'licence'), ('law', 'court'), ('law', 'lawsuit'), ('law', 'permission'), ('data', 'dataset'), ('data', 'index'), ('data', 'benchmark'), ('data', 'model')) AS t(section, word)), c AS (SELECT id, section, count(*) AS hits FROM " + ITEMS + " JOIN k ON contains(lower(title || ' ' || coalesce(content, '')), word) GROUP BY id, section) SELECT id, section, hits FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, section) = 1")
def report_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    """The report section of each item: the one whose keywords it holds most of, the first of equals."""
    low = F.lower(F.concat("title", F.lit(" "), F.coalesce("content", F.lit(""))))
    count = lambda ws: F.size(F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w))).cast("bigint")
    c = F.array(*[F.struct((-count(ws)).alias("n"), F.lit(s).alias("section")) for s, ws in _SECTIONS.items()])
    d = items(spark, sf, "title", "content").where("title IS NOT NULL").select("id", F.array_min(c).alias("b"))
    return d.select("id", "b.section", (-F.col("b.n")).alias("hits")).where("hits > 0")


@query(f"""WITH q AS (SELECT doc_id AS q, string_split(lower(title), ' ') AS w FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL), x AS (SELECT q, w[1] AS a, w[2] AS b, w[3] AS c FROM q WHERE len(w) >= 3),
wd AS (SELECT DISTINCT id, unnest(string_split(lower(title), ' ')) AS word FROM {ITEMS} WHERE title IS NOT NULL), h AS (SELECT q, id, max(CAST(word = a AS INT)) AS ha, max(CAST(word = b AS INT)) AS hb, max(CAST(word = c AS INT)) AS hc FROM x JOIN wd ON word IN (a, b, c) GROUP BY q, id),
g AS (SELECT q, count(*) FILTER (WHERE ha + hb + hc = 3) AS s0, count(*) FILTER (WHERE ha + hb = 2) AS s1, count(*) FILTER (WHERE ha = 1) AS s2 FROM h GROUP BY q)
SELECT x.q, CASE WHEN coalesce(s0, 0) >= 2 THEN 'baseline' WHEN coalesce(s1, 0) >= 2 THEN 'widen_terms' WHEN coalesce(s2, 0) >= 2 THEN 'rewrite' ELSE 'collect' END AS step, CASE WHEN coalesce(s0, 0) >= 2 THEN s0 WHEN coalesce(s1, 0) >= 2 THEN s1 WHEN coalesce(s2, 0) >= 2 THEN s2 ELSE 0 END AS evidence FROM x LEFT JOIN g USING (q)""")
def widening_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """How far each query has to be widened until two items answer it: all its terms, two, one, or new material. One plan for all queries."""
    w = F.split(F.lower("title"), " ")
    x = load(spark, sf, "documents").where("doc_id % 20 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("q"), w.alias("w")).where(F.size("w") >= 3).select("q", *[F.get("w", F.lit(i)).alias(c) for i, c in enumerate("abc")])
    asked = x.select("q", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("word")).join(x, "q")
    wd = items(spark, sf, "title").where("title IS NOT NULL").select("id", F.explode(F.array_distinct(w)).alias("word"))
    h = asked.join(wd, "word").groupBy("q", "id").agg(*[F.max((F.col("word") == F.col(c)).cast("int")).alias("h" + c) for c in "abc"])
    g = h.groupBy("q").agg(F.count_if(F.expr("ha + hb + hc = 3")).alias("s0"), F.count_if(F.expr("ha + hb = 2")).alias("s1"), F.count_if(F.expr("ha = 1")).alias("s2"))
    z = x.select("q").join(g, "q", "left").fillna(0)
    s0, s1, s2 = F.col("s0"), F.col("s1"), F.col("s2")
    return z.select("q", F.when(s0 >= 2, "baseline").when(s1 >= 2, "widen_terms").when(s2 >= 2, "rewrite").otherwise("collect").alias("step"), F.when(s0 >= 2, s0).when(s1 >= 2, s1).when(s2 >= 2, s2).otherwise(0).alias("evidence"))


@query(f"SELECT source_type, count(*) AS n, count(DISTINCT publisher) AS publishers, count(*) FILTER (WHERE length(coalesce(content, '')) >= 400) AS with_body, CAST(quantile_disc(length(coalesce(content, '')), 0.5) AS BIGINT) AS median_chars, round(avg(length(coalesce(content, ''))), 4) AS mean_chars, min(published_at) AS first_day, max(published_at) AS last_day FROM {ITEMS} GROUP BY source_type")
def corpus_coverage_probe(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length(F.coalesce("content", F.lit(""))).cast("bigint")
    d = items(spark, sf, "source_type", "publisher", "content", "published_at").withColumn("n", n)
    return d.groupBy("source_type").agg(F.count("*").alias("c"), F.countDistinct("publisher").alias("publishers"), F.count_if(F.col("n") >= 400).alias("with_body"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("bigint").alias("median_chars"), F.round(F.avg("n"), 4).alias("mean_chars"), F.min("published_at").alias("first_day"), F.max("published_at").alias("last_day")).withColumnRenamed("c", "n")


@query(f"""WITH t(ranker) AS (VALUES ('length'), ('trust'), ('newest')), r AS (SELECT ranker, id, contains(lower(coalesce(title, '')), 'council') AS relevant, length(coalesce(content, '')) >= 400 AS body, publisher,
 row_number() OVER (PARTITION BY ranker ORDER BY CASE ranker WHEN 'length' THEN -length(coalesce(content, '')) WHEN 'trust' THEN -coalesce(trust, 0) ELSE -epoch_us(coalesce(published_at, TIMESTAMPTZ '1970-01-01')) END, id) AS rank FROM {ITEMS}, t)
SELECT ranker, CAST(max(CAST(rank = 1 AND relevant AS INT)) AS BIGINT) AS top1, min(rank) FILTER (WHERE relevant) AS first_relevant, count(*) FILTER (WHERE rank <= 10 AND body) AS bodies_at_10, count(DISTINCT publisher) FILTER (WHERE rank <= 10) AS publishers_at_10 FROM r GROUP BY ranker""")
def ranker_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """One set of metrics over several rankers: each ranker's place of the first relevant row is a count of the rows before it, its head a top-k."""
    d = items(spark, sf, "title", "content", "trust", "published_at", "publisher")
    keys = {"length": -F.length(F.coalesce("content", F.lit(""))).cast("double"), "trust": -F.coalesce("trust", F.lit(0.0)), "newest": -F.coalesce(F.unix_micros("published_at"), F.lit(0)).cast("double")}
    d = d.select("id", "publisher", F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("council")).alias("rel"), (F.length(F.coalesce("content", F.lit(""))) >= 400).alias("body"), *[k.alias(n) for n, k in keys.items()])
    out = None
    for n in keys:
        o = F.struct(n, "id")
        best = F.broadcast(d.where("rel").agg(F.min(o).alias("b")))  # one row
        place = d.join(best).agg(F.count_if(o < F.col("b")).alias("before"), F.max(F.col("b").isNotNull()).alias("some"))
        head = d.orderBy(n, "id").limit(10).agg(F.count_if("body").alias("bodies_at_10"), F.countDistinct("publisher").alias("publishers_at_10"))
        one = place.join(head).select(F.lit(n).alias("ranker"), (F.col("before") == 0).cast("bigint").alias("top1"), F.when(F.col("some"), F.col("before") + 1).alias("first_relevant"), "bodies_at_10", "publishers_at_10")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT i.id, i.title, CAST(list_count(list_filter(['council', 'court', 'licence', '市议会'], lambda k: contains(lower(i.title), k))) + 0.3 * list_count(list_filter(['labs', 'works'], lambda k: contains(lower(i.title), k))) AS DOUBLE) AS raw FROM {ITEMS} i WHERE i.title IS NOT NULL AND list_count(list_filter(['council', 'court', 'licence', '市议会'], lambda k: contains(lower(i.title), k))) + 0.3 * list_count(list_filter(['labs', 'works'], lambda k: contains(lower(i.title), k))) >= 0.8")
def domain_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords count one, tags 0.3; domains are kept from a threshold on."""
    low = F.lower("title")
    n = lambda ws: F.size(F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w)))
    raw = n(("council", "court", "licence", "市议会")) + F.lit(0.3) * n(("labs", "works"))
    return items(spark, sf, "title").where("title IS NOT NULL").select("id", "title", raw.alias("raw")).where("raw >= 0.8")
