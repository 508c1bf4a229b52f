import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import components, evaluate, merge, retrieval, simhash, trust, versions


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("args,want", [((0.70, 0.5, 0, 1, 1, 1, 0), 0.824190), ((0.35, 0.4, 0, 0, 0.5, 0.8, 0), 0.544879), ((0.70, 0.5, 1, 1, 1, 1, 1), 0.767634)])
def test_trust_score(spark, args, want):
    assert one(spark, trust.score(*[F.lit(float(a)) for a in args])) == pytest.approx(want, abs=1e-6)


def test_freshness(spark):
    now = F.lit("2025-09-15 00:00:00").cast("timestamp")
    assert one(spark, trust.freshness(F.lit("2025-08-01 00:00:00").cast("timestamp"), now)) == pytest.approx(0.707107, abs=1e-6)
    assert one(spark, trust.freshness(F.lit(None).cast("timestamp"), now)) == 0.5


@pytest.mark.parametrize("votes,want", [([("rss", "a", 0.9), ("hackernews", "b", 0.9)], 0.99), ([("rss", "a", 0.4), ("rss", "b", 0.4)], 0.52), ([("rss", "a", 0.9), ("rss", "b", 0.8), ("hackernews", "c", 0.7)], 0.982), ([("rss", "a", 0.4), ("rss", "a", 0.4)], 0.4), ([("rss", None, 0.9), ("rss", "a", 0.4)], 0.4)])
def test_noisy_or(spark, votes, want):
    v = spark.createDataFrame([("c", f"i{k}", *x) for k, x in enumerate(votes)], "claim string, item_id string, source_type string, publisher string, trust double")
    assert trust.noisy_or(v, "claim").first()["confidence"] == pytest.approx(want)


def test_verdict_gate(spark):
    f = lambda c, fam, pub, prior: one(spark, trust.verdict(F.lit(c), F.lit(fam), F.lit(pub), F.lit(prior)))
    assert f(0.99, 2, 2, 0.1) == "supported"
    assert f(0.7998, 1, 1, 0.9) == "unsupported"
    assert f(0.99, 1, 3, 0.40) == "supported" and f(0.99, 1, 3, 0.39) == "unsupported"


def test_publisher(spark):
    f = lambda a, lo, u: one(spark, trust.publisher_of(F.lit(a).cast("string"), F.lit(lo).cast("string"), F.lit(u).cast("string"), ["github.com"]))
    assert f("Ann", None, "https://www.site.example/x") == "site.example"
    assert f("Ann", None, "https://news.site.co.uk/x") == "site.co.uk"
    assert f(" Ann ", None, "https://github.com/o/r") == "ann"
    assert f(None, "/u/Bob", "https://github.com/o/r") == "bob"
    assert f(None, "@Eve", None) == "eve" and f(None, None, None) is None


def test_urls(spark):
    u = "HTTPS://Host.Example:443/a/b/?utm_source=x&b=2&a=1#frag"
    assert one(spark, T.canonical_url(F.lit(u))) == "https://host.example:443/a/b/?a=1&b=2"
    assert one(spark, T.dedup_key(F.lit(u))) == "https|host.example|/a/b|b=2&a=1"
    assert one(spark, T.canonical_url(F.lit("ftp://x/y"))) is None


def test_counts_and_dates(spark):
    assert [one(spark, T.human_count(F.lit(x))) for x in ("1.2万", "3亿", "5k", "12,345", "none")] == [12000, 300000000, 5000, 12345, None]
    now = F.lit("2025-09-15 12:00:00").cast("timestamp")
    f = lambda x: one(spark, T.parse_when(F.lit(x), now))
    assert str(f("3天前")) == "2025-09-12 12:00:00" and str(f("2025-01-02T03:04:05")) == "2025-01-02 03:04:05"
    assert str(f("1700000000")) == str(f("1700000000000")) and f("no date") is None
    assert str(f("Mon, 01 Sep 2025 10:00:00 GMT")) == "2025-09-01 10:00:00"


def test_archive_bm25(spark):
    d = spark.createDataFrame([(1, "alpha alpha b1 b2 b3 b4 b5 b6 b7 b8"), (2, "alpha b1 b2 b3 b4"), (3, "b1 b2 b3 b4 b5 b6 b7 b8 b9")], "k long, t string")
    q = spark.createDataFrame([("q", "alpha")], "query_id string, term string")
    got = {r["k"]: round(r["score"], 6) for r in retrieval.bm25(d, "k", F.col("t"), q).collect()}
    assert got == {1: 0.621492, 2: 0.565418}


def test_hybrid(spark):
    f = lambda t, s, n, tr: one(spark, retrieval.hybrid_score(F.lit(t), F.lit(s), F.lit(n), F.lit(tr), ["fusi"]))
    assert f("fusi power", "", 1200, 0.7) == pytest.approx(1 * 0.45 + math.log1p(1200) / math.log1p(2000) * 0.35 + 0.14 + 0.12)
    assert f("other", "on fusi", 50, 0.5) == pytest.approx(0.3 * 0.45 + math.log1p(50) / math.log1p(2000) * 0.15 * 0.35 + 0.1)


def test_diversity(spark):
    d = spark.createDataFrame([(k, "p", 1.0) for k in range(4)], "id long, publisher string, score double")
    assert [round(r["final"], 6) for r in retrieval.diversify(d, "publisher", "score", "id", 10).orderBy("id").collect()] == [1, 0.72, 0.5184, 0.373248]


def test_rank_fusion_over_partitions(spark):
    a = spark.createDataFrame([(k, float(k % 7)) for k in range(200)], "id long, s double").repartition(5)
    want = sorted([(k, float(k % 7)) for k in range(200)], key=lambda x: (-x[1], x[0]))
    got = {r["id"]: r["rank"] for r in retrieval.ranked(a, "id", "s").collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(want)}
    assert retrieval.fused_by_rank([a, a], "id", "s").where("id = 6").first()["rrf"] == pytest.approx(2 / 61)


@pytest.mark.parametrize("distance", range(7))
def test_bands_are_exact(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(6)]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    got = {(r["fp_a"], r["fp_b"]) for r in simhash.near_pairs(spark.createDataFrame([(s,) for s in signed + [None]], "fingerprint long"), distance).collect()}
    want = {(min(a, b), max(a, b)) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance}
    assert got == want


def test_simhash_edges(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, "same words here"), (4, "Same WORDS here")], "k long, t string")
    got = {r["k"]: r["fingerprint"] for r in simhash.fingerprints(d, "k", "t").collect()}
    assert got[1] == got[2] == 0 and got[3] == got[4] != 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(300 + k, 301 + k) for k in range(40)] + [(500, 500), (None, 3)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in par}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_versions_and_append(spark):
    d = spark.createDataFrame([("u", "t1", 1), ("u", "t1", 2), ("u", "t2", 3), ("u", "t1", 2)], "url string, text string, at int")
    o, v, s = versions.version_rows(d, "url", ["text"], "at")
    assert (o.count(), v.count(), s.count()) == (1, 2, 3)
    old = spark.createDataFrame([("a", 1)], "id string, x int")
    assert [tuple(r) for r in versions.append_new(old, spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "id string, x int"), "id").collect()] == [("b", 2)]


def test_merge_pieces(spark):
    e = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, None), ("k", 5, None), ("k", 6, "a")], "k string, t int, l string")
    assert [(r["l"], r["n"]) for r in merge.run_lengths(e, "k", ["t"], "l").orderBy("run").collect()] == [("a", 2), ("b", 1), (None, 2), ("a", 1)]
    b, a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "k string, v string"), spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1"), ("z", None)], "k string, v string")
    assert {tuple(r) for r in merge.state_delta(b, a, "k", "v").collect()} == {("y", "1", "2"), ("w", None, "1")}


def test_ir_metrics(spark):
    runs = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc string, rank int")
    q = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("none", "z", 1)], "query_id string, doc string, grade int")
    got = {r["query_id"]: r for r in evaluate.ir_metrics(runs, q, 3).collect()}
    assert got["q"]["ndcg"] == pytest.approx(0.796708, abs=1e-6) and got["q"]["recall"] == 1 and got["none"]["rr"] == 0


def test_threshold_grid(spark):
    p = spark.createDataFrame([(0.2, False), (0.4, False), (0.6, True), (0.9, True)], "score double, positive boolean")
    r = evaluate.threshold_grid(p).first()
    assert r["threshold"] == pytest.approx(0.41) and r["f1"] == 1
    assert evaluate.threshold_grid(p.where("positive")).count() == 0


def test_siblings_of_all_orders(spark, tmp_path):
    import random

    from gleaner.plans.relational_queries import sibling_claims_all

    rng = random.Random(1)
    orders = [(k, rng.randrange(9) if k else None, rng.choice(["1-URGENT", "5-LOW"])) for k in range(30)]
    lines = [(rng.randrange(30), rng.randrange(25)) for _ in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    e = {(orders[o][1], i) for o, i in lines if orders[o][1] is not None}
    want = {c: len({d for d, j in e for x, i in e if x == c and i == j and d != c}) for c, _ in e}
    assert {r["claim"]: r["siblings"] for r in sibling_claims_all(spark, str(tmp_path)).collect()} == {c: n for c, n in want.items() if n}


def test_nearest_of_every_query(spark, tmp_path):
    import random

    from gleaner.plans.text_queries import cosine_topk_all

    rng = random.Random(2)
    vecs = {k: [rng.gauss(0.3, 1) for _ in range(5)] for k in range(90)}
    spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in cosine_topk_all(spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["vec_id"]))
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q in (0, 20, 40, 60, 80):
        sim = {k: round(sum(x * y for x, y in zip(v, vecs[q])) / norm(v) / norm(vecs[q]), 6) for k, v in vecs.items()}
        assert [k for _, k in sorted(got.pop(q))] == sorted((k for k in sim if sim[k] > 0), key=lambda k: (-sim[k], k))[:30]
    assert not got


def test_near_pairs_alike_for_any_number_of_blocks(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(1, 9))) for f in fps]
    d = spark.createDataFrame([(f,) for f in fps] + [(None,)], "fingerprint long")
    want = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 6}
    for shared in (None, 2, 3):
        assert {(r["fp_a"], r["fp_b"]) for r in simhash.near_pairs(d, 6, shared).collect()} == want


def test_near_pairs_in_long_lists_come_once(spark):
    """Dense lists: no pair comes twice from the keys it shares (no distinct over all finds, which fails by size), and links keep the components."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({(c ^ sum(1 << b for b in rng.sample(range(20, 44), rng.randrange(6)))) - (1 << 63) for c in centres for _ in range(220)} | {rng.getrandbits(64) - (1 << 63) for _ in range(80)})
    d = spark.createDataFrame([(f,) for f in fps + fps[:50]], "fingerprint long").repartition(3)
    want = Counter((a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 6)
    pairs = simhash.near_pairs(d, 6)
    assert Counter((r["fp_a"], r["fp_b"]) for r in pairs.collect()) == want
    links = simhash.near_links(d, 6)
    assert links.count() < len(want) / 4
    got = components.connected_components(links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, components.connected_components(pairs, "fp_a", "fp_b").collect()))
    assert simhash.near_pairs(d.limit(0), 6).count() == simhash.near_links(d.limit(0), 6).count() == 0
    # nothing but the index is shuffled
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
