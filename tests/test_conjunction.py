"""Lists of terms against the items that hold them: whole results over many blocks, without a join of postings."""

import random

import pytest

from gleaner.operators import claims as C
from gleaner.operators import conjunction
from gleaner.plans import parse_queries

WORDS = ["council", "licence", "museum", "turbine", "harbour", "dataset", "ferry", "orchard"]


def linked(claims, items, limit=8):
    want = set()
    for cid, terms in claims:
        hits = {}
        for iid, title, content in items:
            held = set(f"{title or ''} {content or ''}".lower().split())
            has = [t in held for t in terms]
            level = 1 if all(has) else 2 if all(has[:3]) else 3 if all(has[:2]) else None
            if terms and level:
                hits[iid] = (level, sum(has))
        best = min((x for x, _ in hits.values()), default=None)
        top = sorted((-s, i) for i, (x, s) in hits.items() if x == best)[:limit]
        want |= {(cid, i, best, -s, n + 1) for n, (s, i) in enumerate(top)}
    return want


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_links_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(conjunction, "BLOCK", block)
    rng = random.Random(3)
    items = [(f"i{k:03d}", " ".join(rng.sample(WORDS, 2)), " ".join(rng.sample(WORDS, rng.randrange(3))) or None) for k in range(60)] + [("i900", None, None), ("i901", "", " ")]
    claims = [(k, rng.sample(WORDS + ["absent"], rng.randrange(5))) for k in range(40)]
    got = C.link_evidence(spark.createDataFrame([(*c, None) for c in claims], "claim_id long, terms array<string>, origin string"), spark.createDataFrame(items, "item_id string, title string, content string"))
    assert {tuple(r) for r in got.collect()} == linked(claims, items)
    # a frequent term's claims don't meet each of its items in a join
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_document_frequency_of_unique_keys(spark):
    d = spark.createDataFrame([(1, "ferry ferry museum"), (2, "ferry"), (3, None)], "k long, t string")
    for unique in (False, True):
        assert {tuple(r) for r in C.document_frequency(d, "k", "t", unique).collect()} == {("ferry", 2), ("museum", 1)}


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_search_relaxed_over_blocks(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(conjunction, "BLOCK", block)
    rng = random.Random(4)
    items = [(f"i{k}", " ".join(rng.sample(WORDS, 2)), " ".join(rng.sample(WORDS, rng.randrange(3))) or None) for k in range(50)]
    docs = [(20 * k, " ".join(rng.sample(WORDS, rng.randrange(1, 4)) + rng.choice([[], ["a"], ["unheard"], ["ferry", "ferry"]]))) for k in range(40)] + [(800, "a b"), (820, None), (21, "ferry")]
    spark.createDataFrame(items + items[:5], "id string, title string, content string").write.parquet(f"{tmp_path}/corpus_items.parquet")
    spark.createDataFrame(docs, "doc_id long, title string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    held = [set(f"{t} {c or ''}".split(" ")) for _, t, c in items]
    for q, title in docs:
        w = [x for x in (title or "").split(" ") if len(x) >= 3]
        if q % 20 == 0 and w:
            every, one = sum(set(w) <= h for h in held), sum(max(w, key=len) in h for h in held)
            want.add((q, "all", every) if every else (q, "longest", one))
    got = parse_queries.search_relaxed(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want
    # the only join adds the counts to the queries: words don't meet their items in one
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
