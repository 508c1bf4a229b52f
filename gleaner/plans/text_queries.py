"""Queries of the core operators over the items, documents and event tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import components, merge, retrieval, simhash
from gleaner.session import cut, shared_dir, spread, values

QUERIES: dict = {}
ORACLES: dict = {}


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """corpus_items, replayed rows once (rows repeat whole)."""
    return load(spark, sf, "corpus_items").select("id", *cols).dropDuplicates(["id"])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ITEMS = "(SELECT DISTINCT ON (id) * FROM corpus_items)"
HAN = "\\x{3400}-\\x{9fff}"
STOPS = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


def sql_tokens(text: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+(?:\\.[a-z0-9]+)*[+#]*|[{HAN}]+'),
      lambda w: CASE WHEN regexp_matches(w, '^[{HAN}]{{2,}}') THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) WHEN w IN {STOPS} THEN [] ELSE [w] END))"""


def sql_bm25(docs: str, key: str, text: str, terms: str) -> str:
    """CTEs ending in scored(query_id, key, score); ``terms``: a query giving (query_id, term)."""
    return f"""WITH tk AS (SELECT {key}, {sql_tokens(text)} AS ts FROM {docs}), st AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM tk),
    ex AS (SELECT {key}, len(ts) AS ln, unnest(ts) AS term FROM tk), po AS (SELECT {key}, term, count(*) AS tf, any_value(ln) AS ln FROM ex GROUP BY ALL),
    qt AS ({terms}), dfs AS (SELECT term, count(*) AS d FROM po WHERE term IN (SELECT term FROM qt) GROUP BY term),
    scored AS (SELECT query_id, {key}, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / av))) AS score FROM qt JOIN po USING (term) JOIN dfs USING (term), st GROUP BY query_id, {key})"""


# ---------------------------------------------------------------- retrieval
TERMS = ["open", "licence", "dataset", "4.11"]


@query(sql_bm25("documents", "doc_id", "concat_ws(' ', title, title, text)", "SELECT 'q' AS query_id, unnest(['open', 'licence', 'dataset', '4.11']) AS term") + "SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def bm25_archive_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = values(spark, [("q", t) for t in TERMS], "query_id string, term string")
    got = retrieval.bm25(spread(load(spark, sf, "documents").select("doc_id", "title", "text")), "doc_id", F.concat_ws(" ", "title", "title", "text"), q).select("doc_id", F.round("score", 6).alias("score"))
    return got.orderBy(F.desc("score"), "doc_id").limit(20)


@query(sql_bm25("documents", "doc_id", "text", f"SELECT DISTINCT question AS query_id, unnest({sql_tokens('question')}) AS term FROM eval_passages WHERE question IS NOT NULL") + "SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10")
def bm25_multi_query_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "eval_passages").where("question IS NOT NULL").select(F.col("question").alias("query_id")).distinct()
    q = p.select("query_id", F.explode(T.archive_tokens(F.col("query_id"))).alias("term")).distinct()
    s = retrieval.bm25(spread(load(spark, sf, "documents").select("doc_id", "text")), "doc_id", F.col("text"), q).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 10").select("query_id", "doc_id", "rank", "score")


@query(sql_bm25("documents", "doc_id", "concat_ws(' ', title, title, text)", "SELECT * FROM (VALUES ('a', 'open'), ('a', 'licence'), ('b', 'dataset'), ('b', '4.11')) AS t(query_id, term)") + "SELECT query_id, doc_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 20")
def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranking from a written inverted index: built once, then each query reads the buckets of its terms."""
    path = f"{shared_dir(spark)}/gleaner/index-{uuid.uuid4().hex}"
    retrieval.build_index(spread(load(spark, sf, "documents").select("doc_id", "title", "text")), "doc_id", F.concat_ws(" ", "title", "title", "text"), path)
    s = retrieval.search_index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), [("a", "open"), ("a", "licence"), ("b", "dataset"), ("b", "4.11")], "doc_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("score", F.round("score", 6)).withColumn("r", F.row_number().over(w)).where("r <= 20").drop("r")


@query(f"""WITH tk AS (SELECT doc_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, count(*) > 0.2 * any_value(n.n) AS generic FROM tk, n GROUP BY term""")
def term_df_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(load(spark, sf, "documents").select("text"))
    n = load(spark, sf, "documents").agg(F.count("*").alias("n"))
    df = d.select(F.explode(F.array_distinct(T.archive_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", (F.col("df") > 0.2 * F.col("n")).alias("generic"))


@query(f"""SELECT id, published_at FROM {ITEMS} WHERE contains(lower(concat_ws(' ', title, content, author)), 'licence') AND contains(lower(concat_ws(' ', title, content, author)), 'council') ORDER BY published_at DESC, id LIMIT 50""")
def search_and_terms(spark: SparkSession, sf: str) -> DataFrame:
    blob = F.lower(F.concat_ws(" ", "title", "content", "author"))
    d = items(spark, sf, "title", "content", "author", "published_at").where(blob.contains("licence") & blob.contains("council"))
    return d.orderBy(F.desc("published_at"), "id").limit(50).select("id", "published_at")


@query(f"""WITH b AS (SELECT id, lower(concat_ws(' ', title, content, author)) AS t FROM {ITEMS})
SELECT id, CASE WHEN contains(t, 'turbine') THEN 0 ELSE 1 END AS leg FROM b WHERE contains(t, 'turbine') OR contains(t, '预算') ORDER BY leg, id LIMIT 60""")
def search_mixed_short_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of three and more characters are all required; shorter ones add rows behind them up to the limit."""
    blob = F.lower(F.concat_ws(" ", "title", "content", "author"))
    d = items(spark, sf, "title", "content", "author").select("id", blob.alias("t"))
    long, short = F.col("t").contains("turbine"), F.col("t").contains("预算")
    return d.where(long | short).select("id", F.when(long, 0).otherwise(1).alias("leg")).orderBy("leg", "id").limit(60)


@query(f"""SELECT id, title, published_at FROM {ITEMS} WHERE source_type = 'rss' ORDER BY published_at DESC, id LIMIT 50""")
def recent_by_family(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf, "source_type", "title", "published_at").where("source_type = 'rss'").orderBy(F.desc("published_at"), "id").limit(50).select("id", "title", "published_at")


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "title", "content", "trust", "publisher")
    s = retrieval.hybrid_score(F.col("title"), F.substring("content", 1, 400), F.length("content"), F.col("trust"), ["turbine", "licence"])
    return d.select("id", "publisher", F.round(s, 6).alias("score"))


_HYB = f"""WITH b AS (SELECT id, publisher, regexp_replace(lower(coalesce(title, '')), '\\s+', '', 'g') AS nt, regexp_replace(lower(coalesce(title, '') || coalesce(substr(content, 1, 400), '')), '\\s+', '', 'g') AS nb,
  coalesce(length(content), 0) AS n, CASE WHEN coalesce(trust, 0) = 0 THEN 0.5 ELSE trust END AS tr FROM {ITEMS}),
c AS (SELECT *, greatest(CAST(floor(length(nt) * 0.6) AS INT), 1) AS l0, instr(nt, 'turbine') - 1 AS p1, instr(nt, 'licence') - 1 AS p2 FROM b),
d AS (SELECT *, CASE WHEN p1 >= 0 AND p1 < l0 THEN greatest(l0, p1 + 7) ELSE l0 END AS l1 FROM c),
e AS (SELECT *, CASE WHEN p2 >= 0 AND p2 < l1 THEN greatest(l1, p2 + 7) ELSE l1 END AS l2 FROM d),
h AS (SELECT id, publisher, round(
  ((CASE WHEN contains(nt, 'turbine') THEN 1 + ln(6) WHEN contains(nb, 'turbine') THEN (1 + ln(6)) * 0.3 ELSE 0 END + CASE WHEN contains(nt, 'licence') THEN 1 + ln(6) WHEN contains(nb, 'licence') THEN (1 + ln(6)) * 0.3 ELSE 0 END) / (2 * (1 + ln(6)))) * 0.45
  + least(ln(1 + n) / ln(2001), 1.0) * CASE WHEN n < 400 THEN 0.15 ELSE 1 END * 0.35 + tr * 0.2
  + CASE WHEN contains(substr(nt, 1, l2), 'turbine') OR contains(substr(nt, 1, l2), 'licence') THEN 0.12 ELSE 0 END, 6) AS score FROM e)"""


@query(_HYB + "SELECT id, score FROM h ORDER BY score DESC, id LIMIT 100")
def hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf).select("id", "score").orderBy(F.desc("score"), "id").limit(100)


@query(_HYB + ", r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(publisher, '?') ORDER BY score DESC, id) - 1 AS k FROM h) SELECT id, publisher, score, round(score * pow(0.72, k), 6) AS final FROM r ORDER BY final DESC, id LIMIT 100")
def hybrid_rerank_diverse(spark: SparkSession, sf: str) -> DataFrame:
    d = retrieval.diversify(_hybrid(spark, sf), "publisher", "score", "id", 100)
    return d.select("id", "publisher", "score", F.round("final", 6).alias("final")).orderBy(F.desc("final"), "id").limit(100)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS similarity FROM embeddings, q)
SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM s WHERE similarity > 0 QUALIFY place <= 30""")
def cosine_topk_all(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 nearest of every 20th vector among all; the rank limit cuts each task's rows before the shuffle."""
    e = load(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = spread(e).crossJoin(q).select("query_id", "vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")).where("similarity > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return s.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 30")


@query(_HYB + """, a AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM h), b2 AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY coalesce(trust, 0) DESC, id)) AS p FROM """ + ITEMS + """)
SELECT id, round(sum(p), 8) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b2) GROUP BY id ORDER BY rrf DESC, id LIMIT 100""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    a = _hybrid(spark, sf).select("id", "score")
    b = items(spark, sf, "trust").select("id", F.coalesce("trust", F.lit(0.0)).alias("score"))
    # ranks of the whole lists, by a range-partitioned sort and per-partition offsets
    return retrieval.fused_by_rank([a, b], "id", "score").select("id", F.round("rrf", 8).alias("rrf")).orderBy(F.desc("rrf"), "id").limit(100)


@query(f"""WITH a AS (SELECT id, title, 0 AS pool, row_number() OVER (ORDER BY length(title), id) AS pos FROM {ITEMS} WHERE contains(lower(title), 'turbine') QUALIFY pos <= 60),
b AS (SELECT id, title, 1 AS pool, row_number() OVER (ORDER BY trust DESC NULLS LAST, id) AS pos FROM {ITEMS} WHERE contains(lower(content), 'turbine') QUALIFY pos <= 90),
u AS (SELECT *, substr(lower(title), 1, 80) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT id, pool, pos FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY pool, pos, id) = 1""")
def candidate_pool_union(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "title", "content", "trust")
    ta = d.where(F.lower("title").contains("turbine")).orderBy(F.length("title"), "id").limit(60)
    tb = d.where(F.lower("content").contains("turbine")).orderBy(F.desc_nulls_last("trust"), "id").limit(90)
    # both pools are bounded by their limits
    a = ta.withColumn("pos", F.row_number().over(Window.orderBy(F.length("title"), "id"))).withColumn("pool", F.lit(0))
    b = tb.withColumn("pos", F.row_number().over(Window.orderBy(F.desc_nulls_last("trust"), "id"))).withColumn("pool", F.lit(1))
    u = a.unionByName(b).select("id", F.substring(F.lower("title"), 1, 80).alias("k"), "pool", F.col("pos").cast("bigint").alias("pos"))
    return merge.keep_first(u, ["k"], ["pool", "pos", "id"]).select("id", "pool", "pos")


@query("SELECT doc_id, trim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 400)) AS excerpt FROM documents")
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.trim(T.excerpt(F.col("text"))).alias("excerpt"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 400) || chr(10) || '[...]' || chr(10) || substr(text, CAST(floor((length(text) - 300) / 2) AS INT) + 1, 300) || chr(10) || '[...]' || chr(10) || substr(text, length(text) - 299, 300) END AS sampled FROM documents""")
def head_middle_tail(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.head_middle_tail(F.col("text"), 1000).alias("sampled"))


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 500)) AS s FROM documents),
h AS (SELECT doc_id, text, s, CAST((length(substr(lower(text), CAST(s AS INT) + 1, 600)) - length(replace(substr(lower(text), CAST(s AS INT) + 1, 600), 'licence', ''))) / 7 AS INT) AS hits FROM w)
SELECT doc_id, substr(text, CAST(s AS INT) + 1, 600) AS excerpt FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, s) = 1""")
def excerpt_window(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.best_window(F.col("text"), ["licence"], 600, 500).alias("excerpt"))


# ---------------------------------------------------------------- corpus statistics
@query(f"""SELECT count(*) AS items, count(DISTINCT cluster_id) AS clusters, count(DISTINCT publisher) AS publishers, count(*) FILTER (WHERE length(content) >= 400) AS with_body, count(*) FILTER (WHERE published_at > fetched_at) AS future, round(avg(length(content)), 4) AS mean_length FROM {ITEMS}""")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "cluster_id", "publisher", "content", "published_at", "fetched_at")
    return d.agg(F.count("*").alias("items"), F.countDistinct("cluster_id").alias("clusters"), F.countDistinct("publisher").alias("publishers"), F.count_if(F.length("content") >= 400).alias("with_body"), F.count_if(F.col("published_at") > F.col("fetched_at")).alias("future"), F.round(F.avg(F.length("content")), 4).alias("mean_length"))


@query(f"SELECT source_type, count(*) AS n FROM {ITEMS} GROUP BY source_type ORDER BY n DESC, source_type")
def families_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf, "source_type").groupBy("source_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_type")


@query(f"SELECT source_type, count(*) AS n, CAST(sum(CASE WHEN length(content) >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS bodies, round(avg(CASE WHEN length(content) >= 400 THEN 1.0 ELSE 0.0 END), 6) AS share FROM {ITEMS} GROUP BY source_type")
def conditional_body_rate(spark: SparkSession, sf: str) -> DataFrame:
    long = F.when(F.length("content") >= 400, 1).otherwise(0)
    return items(spark, sf, "source_type", "content").groupBy("source_type").agg(F.count("*").alias("n"), F.sum(long).alias("bodies"), F.round(F.avg(long.cast("double")), 6).alias("share"))


@query(f"SELECT id FROM {ITEMS} i WHERE EXISTS (SELECT 1 FROM engagement_snapshots e WHERE e.item_id = i.id)")
def known_ids_semi(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).join(load(spark, sf, "engagement_snapshots").select(F.col("item_id").alias("id")), "id", "left_semi")


@query(f"SELECT id FROM {ITEMS} i WHERE NOT EXISTS (SELECT 1 FROM engagement_snapshots e WHERE e.item_id = i.id)")
def missing_snapshots_anti(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).join(load(spark, sf, "engagement_snapshots").select(F.col("item_id").alias("id")), "id", "left_anti")


@query(f"WITH t AS (SELECT title FROM {ITEMS} WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 3) SELECT id FROM {ITEMS} WHERE title IS NOT NULL AND title NOT IN (SELECT title FROM t)")
def templated_titles_having(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "title").where("title IS NOT NULL")
    often = d.groupBy("title").agg(F.count("*").alias("n")).where("n > 3")
    return d.join(often, "title", "left_anti").select("id")


@query(f"WITH h AS (SELECT id, md5(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) AS k FROM {ITEMS} WHERE trim(content) <> '') SELECT k AS content_key, min(id) AS first_id, count(*) AS n FROM h GROUP BY k HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "content").where(F.trim("content") != "").select("id", F.md5(F.trim(F.regexp_replace(F.lower("content"), "\\s+", " "))).alias("content_key"))
    return d.groupBy("content_key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


# ---------------------------------------------------------------- near duplicates by fingerprint
_SIM = """WITH f AS (SELECT doc_id, unnest(flatten(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.+#-]*|[\\x{4e00}-\\x{9fff}]+'),
  lambda w: CASE WHEN regexp_matches(w, '^[\\x{4e00}-\\x{9fff}]{2,}') THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) WHEN regexp_matches(w, '^[\\x{4e00}-\\x{9fff}]$') THEN ['@' || w] ELSE [w] END))) AS t FROM documents),
c AS (SELECT doc_id, t, count(*) AS w FROM f GROUP BY doc_id, t), h AS (SELECT doc_id, w, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(md5(t), 9, 8) AS BIGINT) AS lo FROM c),
s AS (SELECT doc_id, """ + ", ".join(f"sum(CASE WHEN ({h} >> {i}) & 1 = 1 THEN w ELSE -w END) AS b{i + o}" for h, o in (("lo", 0), ("hi", 32)) for i in range(32)) + " FROM h GROUP BY doc_id), g AS (SELECT doc_id, " + " + ".join(f"(CASE WHEN b{i} > 0 THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64)) + " AS u FROM s) SELECT d.doc_id, coalesce(CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT), 0) AS fingerprint FROM documents d LEFT JOIN g USING (doc_id)"


@query(_SIM)
def simhash_md5(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.fingerprints(spread(load(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


_FP = f"""f AS (SELECT DISTINCT fingerprint FROM {ITEMS} WHERE fingerprint IS NOT NULL), p AS (SELECT a.fingerprint AS fp_a, b.fingerprint AS fp_b, bit_count(xor(a.fingerprint, b.fingerprint)) AS distance FROM f a JOIN f b ON a.fingerprint < b.fingerprint AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 6)"""


@query("WITH " + _FP + " SELECT fp_a, fp_b, CAST(distance AS INT) AS distance FROM p")
def near_dup_pairs_banded(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_pairs(items(spark, sf, "fingerprint"), 6)


@query("WITH RECURSIVE " + _FP + f""", e AS (SELECT fp_a AS a, fp_b AS b FROM p UNION SELECT fp_b, fp_a FROM p), r AS (SELECT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT n, min(m) AS component FROM r GROUP BY n) SELECT i.id, coalesce(c.component, i.fingerprint) AS cluster FROM {ITEMS} i LEFT JOIN c ON i.fingerprint = c.n WHERE i.fingerprint IS NOT NULL""")
def near_dup_components(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf, "fingerprint").where("fingerprint IS NOT NULL")
    c = components.connected_components(cut(simhash.near_links(d, 6), "links"))
    return d.join(c, F.col("fingerprint") == F.col("node"), "left").select("id", F.coalesce("component", "fingerprint").alias("cluster"))


_SHI = f"""i AS (SELECT id, cluster_id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS b FROM {ITEMS} WHERE cluster_id IS NOT NULL AND trim(content) <> ''),
s AS (SELECT cluster_id, b, min(id) AS id, count(*) AS n FROM i GROUP BY cluster_id, b),
g AS (SELECT id, cluster_id, CASE WHEN length(b) >= 5 THEN list_distinct(list_transform(range(1, length(b) - 3), lambda i: substr(b, i, 5))) ELSE [b] END AS g FROM s),
j AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.g, b.g)) AS k, len(a.g) AS na, len(b.g) AS nb FROM g a JOIN g b ON a.cluster_id = b.cluster_id AND a.id < b.id)"""


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """(id, cluster_id, b): normalised bodies of grouped items."""
    d = items(spark, sf, "cluster_id", "content").where("cluster_id IS NOT NULL AND trim(content) <> ''")
    return d.select("id", "cluster_id", F.trim(F.regexp_replace(F.lower("content"), "\\s+", " ")).alias("b"))


PAIR_BLOCK = 200


def _shingle_pairs(classes: DataFrame) -> DataFrame:
    """Pairs between the distinct bodies of a group; copies are one class. Hashed shingles are written once, not worked out per pair.

    A group meets itself block by block, so no task holds more than two blocks of a hot one.
    """
    d = cut(classes.select("id", "cluster_id", F.transform(T.shingles(F.col("b")), lambda g: F.xxhash64(g)).alias("g")), "shingles")
    size = d.groupBy("cluster_id").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("nb"))
    r = d.join(size, "cluster_id").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    a = r.withColumn("j", F.explode(F.sequence("blk", F.col("nb") - 1))).select(F.col("id").alias("x"), "cluster_id", F.col("blk").alias("i"), "j", F.col("g").alias("gx"))
    b = r.withColumn("i", F.explode(F.sequence(F.lit(0), "blk"))).select(F.col("id").alias("y"), "cluster_id", "i", F.col("blk").alias("j"), F.col("g").alias("gy"))
    # within one block each pair meets in both orders, between two blocks in one
    both = a.join(b, ["cluster_id", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).where("x <> y")
    return cut(both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.round(T.jaccard(F.col("gx"), F.col("gy")), 6).alias("jaccard")), "jaccard")


@query("WITH " + _SHI + " SELECT id_a, id_b, round(k / (na + nb - k), 6) AS jaccard FROM j WHERE round(k / (na + nb - k), 6) >= 0.1")
def shingle_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _shingle_pairs(_bodies(spark, sf).groupBy("cluster_id", "b").agg(F.min("id").alias("id"))).where("jaccard >= 0.1")


@query("WITH " + _SHI + """, u AS (SELECT id_a AS id, round(k / (na + nb - k), 6) AS x FROM j UNION ALL SELECT id_b, round(k / (na + nb - k), 6) FROM j UNION ALL SELECT id, 1.0 FROM s WHERE n > 1),
m AS (SELECT id, max(x) AS template FROM u GROUP BY id) SELECT i.id, m.template FROM i JOIN s ON i.cluster_id = s.cluster_id AND i.b = s.b JOIN m ON s.id = m.id""")
def template_score_max(spark: SparkSession, sf: str) -> DataFrame:
    d = _bodies(spark, sf).withColumn("k", F.md5("b"))
    s = d.groupBy("cluster_id", "k").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("b").alias("b"))
    p = _shingle_pairs(s.select(F.col("rep").alias("id"), "cluster_id", "b"))
    both = p.select(F.col("id_a").alias("rep"), "jaccard").unionByName(p.select(F.col("id_b").alias("rep"), "jaccard")).unionByName(s.where("n > 1").select("rep", F.lit(1.0).alias("jaccard")))
    m = both.groupBy("rep").agg(F.max("jaccard").alias("template"))
    return d.join(s.select("cluster_id", "k", "rep"), ["cluster_id", "k"]).join(m, "rep").select("id", "template")
