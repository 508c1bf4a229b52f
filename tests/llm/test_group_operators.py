"""Near-duplicates, survivors and packing against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import neardup, packing, survivor
from gleaner.llm.common import per_batch  # noqa: F401

TOK = packing.TOKENIZER


# ---------------------------------------------------------------- p5
def brute_pairs(rows):
    bags = {}
    for i, t in rows:
        if i is not None and t and t.strip():
            bags[i] = Counter(neardup.tokens(t))
    out = set()
    for a in bags:
        for b in bags:
            if a < b:
                n = sum((bags[a] & bags[b]).values())
                if bags[a] and bags[b] and n >= 0.8 * max(sum(bags[a].values()), sum(bags[b].values())) - 1e-9:
                    out.add((a, b))
    return out


def texts(rng, n):
    vocab = [f"v{k}" for k in range(60)] + ["the", "of", "a"] * 6
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(0, max(2, len(w) // 3))):
                k = rng.randrange(len(w)) if w else 0
                act = rng.random()
                if act < 0.4 and w:
                    w[k] = rng.choice(vocab)
                elif act < 0.7 and w:
                    del w[k]
                else:
                    w.insert(k, rng.choice(vocab))
            if rng.random() < 0.3:
                rng.shuffle(w)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 40, 90, 200]))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_exact(spark, seed):
    rng = random.Random(seed)
    rows = [(f"i{k:03d}", t) for k, t in enumerate(texts(rng, 150))]
    rows += [("i000", rows[0][1]), (None, "x y z"), ("n", None), ("e", " "), ("zh1", "今天天气很好我们去公园"), ("zh2", "我们去公园今天天气很好"), ("long1", "big " * 3000), ("long2", "big " * 2500)]
    d = spark.createDataFrame(rows, "id string, content string").selectExpr("id", "content", "1 as n", "2 as nid", "'q' as bag")
    m, li = neardup.join(d, "id", "content")
    assert {tuple(r) for r in neardup.all_pairs(m, li).collect()} == brute_pairs(rows)


def test_index_finds_every_pair_without_verification():
    rng = random.Random(11)
    bags = [neardup.elements(t) for t in texts(rng, 300)]
    al = np.concatenate(bags)
    sketch = np.bincount(al % neardup.SKETCH, minlength=neardup.SKETCH).astype(np.float32)
    keys, no = neardup.index_keys(bags, sketch, len(bags))
    by = {}
    for k, n in zip(keys.tolist(), no.tolist()):
        by.setdefault(k, set()).add(n)
    cand = {(a, b) for s in by.values() for a in s for b in s if a < b}
    for a in range(300):
        for b in range(a + 1, 300):
            if len(np.intersect1d(bags[a], bags[b])) >= neardup.need(len(bags[a]), len(bags[b])) and len(bags[a]) and len(bags[b]):
                assert (a, b) in cand


def test_signature_bound():
    rng = random.Random(3)
    bags = [neardup.elements(t) for t in texts(rng, 80)]
    sig = np.unpackbits(neardup.signatures(bags), axis=1)
    for a in range(80):
        for b in range(80):
            assert (sig[a] != sig[b]).sum() <= len(np.setxor1d(bags[a], bags[b]))


def test_hot_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = [(f"i{k:02d}", " ".join(f"c{x}" for x in range(40)) + f" own{k}") for k in range(30)]
    m, li = neardup.join(spark.createDataFrame(rows, "id string, content string"), "id", "content")
    assert neardup.all_pairs(m, li).count() == 30 * 29 // 2


def test_join_of_nothing(spark):
    m, li = neardup.join(spark.createDataFrame([], "id string, content string"), "id", "content")
    assert neardup.all_pairs(m, li).count() == 0


def test_packed_keys():
    r = np.random.default_rng(1)
    for top in (1 << 20, 1 << 46):
        k = np.sort(r.integers(0, top, 500).astype(np.uint64))
        assert (neardup.unpacked(neardup.packed(k)) == k).all()
    assert len(neardup.unpacked(neardup.packed(np.array([7], dtype=np.uint64)))) == 1


# ---------------------------------------------------------------- p2
def brute_layers(rows):
    left, out, k = list(range(len(rows))), [0] * len(rows), 1
    dom = lambda a, b: all(x >= y for x, y in zip(a, b)) and a != b
    while left:
        top = [i for i in left if not any(dom(rows[j], rows[i]) for j in left)]
        for i in top:
            out[i] = k
        left = [i for i in left if i not in top]
        k += 1
    return out


def test_layers_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.randrange(3), rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 40))]
        got = survivor.layers_of(*[np.array(c) for c in zip(*rows)]).tolist()
        want = [x if x <= survivor.LAYERS else 0 for x in brute_layers(rows)]
        assert got == want


def test_skyline_of_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(survivor, "PART", 10)
    rng = random.Random(9)
    rows = [("hot", f"i{k}", rng.randrange(3), rng.randrange(50), rng.random(), 120) for k in range(120)] + [("g", "a", 2, 5, 0.5, 2), ("g", "b", 2, 5, 0.5, 2)]
    d = spark.createDataFrame(rows, "grp string, id string, comp int, t long, q double, members long")
    got = {(r["grp"], r["id"]): r["layer"] for r in survivor.skyline(d).collect()}
    hot = rows[:120]
    lay = brute_layers([r[2:5] for r in hot])
    assert {k[1]: v for k, v in got.items() if k[0] == "hot"} == {r[1]: x for r, x in zip(hot, lay) if x <= 3}
    best = min((r for r in hot if r[2] == 2), key=lambda r: (-r[3], -r[4], r[1]))
    assert {tuple(r) for r in survivor.survivors(survivor.skyline(d)).collect()} == {("hot", best[1]), ("g", "a")}


def test_layers_to_the_last():
    rng = random.Random(11)
    for _ in range(60):
        rows = [(rng.randrange(3), rng.randrange(6), rng.choice([-1.0, 0.2, 0.5, 0.7, 0.9])) for _ in range(rng.randrange(1, 60))]
        assert survivor.all_layers(*[np.array(c) for c in zip(*rows)]).tolist() == brute_layers(rows)


def test_fields_from_deep_layers(spark, monkeypatch):
    monkeypatch.setattr(survivor, "PART", 10)
    rng = random.Random(12)
    rows = [(g, f"{g}{k}", rng.randrange(3), rng.randrange(40), rng.randrange(9) / 9, 80) for g in "abc" for k in range(80)]
    lay = {r[1]: x for g in "abc" for r, x in zip([r for r in rows if r[0] == g], brute_layers([r[2:5] for r in rows if r[0] == g]))}
    low = lambda i: lay[i] > 3 and rng.random() < 0.2
    items = [(r[1], r[0], "x" + r[1] if low(r[1]) and r[0] != "c" else None, "y" + r[1]) for r in rows]
    # a whole text in layer 5 against one with less in layer 4
    chain = [("d", f"d{k}", 2, 9 - k, 9.0 - k, 6) for k in range(5)] + [("d", "dx", 1, 6, 6.0, 6)]
    assert brute_layers([r[2:5] for r in chain])[4:] == [5, 5]
    chain[5] = ("d", "dx", 1, 7, 7.0, 6)
    assert brute_layers([r[2:5] for r in chain])[4:] == [5, 4]
    items += [(r[1], "d", r[1] if r[1] in ("d4", "dx") else None, None) for r in chain]
    rows += chain
    lay |= {r[1]: x for r, x in zip(chain, brute_layers([r[2:5] for r in chain]))}
    d = spark.createDataFrame(rows, "grp string, id string, comp int, t long, q double, members long")
    src = spark.createDataFrame(items, "id string, cluster string, author string, url string")
    got = {r["grp"]: (r["survivor_id"], r["author"], r["url"]) for r in survivor.merged(src, "id", "cluster", d, survivor.skyline(d), {k: (F.col(k), F.col(k).isNotNull()) for k in ("author", "url")}).collect()}
    for g in "abcd":
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (lay[r[1]], -r[2], -r[3], -r[4], r[1]))
        value = {i[0]: i[2:] for i in items}
        first = [next((v for r in order if (v := value[r[1]][k]) is not None), None) for k in (0, 1)]
        assert got[g] == (order[0][1], *first)


def test_completeness_and_merge(spark):
    g = spark.createDataFrame([("a", "g", 5, 0.9, 100, 2), ("b", "g", 7, None, 95, 2), ("c", "g", 9, 0.9, 40, 2), ("d", "g", 9, 0.9, 100, 1), ("e", "g", 9, 0.9, 0, 0), ("b", "g", 7, None, 95, 2), ("z", "lone", 1, 1.0, 10, 2)], "id string, grp string, t long, q double, size long, state int")
    c = survivor.completeness(g)
    assert {(r["id"], r["comp"]) for r in c.collect()} == {("a", 2), ("b", 2), ("c", 1), ("d", 1), ("e", 0)}
    s = survivor.skyline(c)
    assert {tuple(r) for r in survivor.survivors(s).collect()} == {("g", "b")}
    items = spark.createDataFrame([("a", "g", "Title", None), ("b", "g", None, None), ("c", "g", "Other", None), ("d", "g", None, "u"), ("e", "g", None, "v"), (None, "g", "x", "x"), ("q", None, "x", "x")], "id string, cluster string, title string, url string")
    m = survivor.merged(items, "id", "cluster", c, s, {k: (F.col(k), F.col(k).isNotNull()) for k in ("title", "url")}).first()
    assert (m["survivor_id"], m["title"], m["url"], m["members"]) == ("b", "Title", "u", 5)


# ---------------------------------------------------------------- p8
def test_plan_seats_every_document():
    rng = random.Random(2)
    hist = Counter(rng.randrange(1, 512) for _ in range(4000))
    lower, upper, patterns = packing.plan(dict(hist), 512, groups=24)
    assert all((p * upper).sum() <= 512 for p, _ in patterns)
    want = np.zeros(len(upper), dtype=int)
    for s, n in hist.items():
        if s >= lower[0]:
            want[np.searchsorted(lower, s, side="right") - 1] += n
    assert (sum(p * t for p, t in patterns) == want).all()
    assert packing.plan({}, 100)[2] == [] and packing.plan({5: 3}, 100)[2] == []


def test_best_fit():
    got = packing.best_fit(["r1", "r2"], [10, 4], ["a", "b", "c", "d"], [4, 9, 7, 2], 10, lambda k: f"n{k}")
    assert got == ["r2", "r1", "n2", "n2"]


def test_packing(spark):
    rng = random.Random(7)
    counts = [(k, rng.choice([1, 3, 40, 100, 255, 256, 257, 600, 1500, rng.randrange(1, 300)])) for k in range(700)]
    d = spark.createDataFrame(counts, "doc_id long, n int").repartition(5)
    got = packing.pack(d, "doc_id", "k", 256, groups=16).collect()
    room = Counter()
    pieces = {}
    for r in got:
        room[r["container_id"]] += r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
    assert max(room.values()) <= 256
    for k, n in counts:
        p = sorted(pieces[k])
        assert p[0][0] == 0 and sum(x for _, x in p) == n and all(a + b == c for (a, b), (c, _) in zip(p, p[1:])) and len(p) == -(-n // 256)
    assert len(room) <= 1.06 * sum(n for _, n in counts) / 256 + 2
    assert packing.pack(d.limit(0), "doc_id", "k", 256).count() == 0


def test_token_counts_and_assignment(spark):
    import os

    if not os.path.exists(TOK):
        pytest.skip("no vocabulary file")
    d = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "wort " * 5000)], "doc_id long, text string").selectExpr("*", "1 as size", "2 as part_no")
    c = spark.createDataFrame([("s", 64), ("s", 64), (None, 5), ("m", 512)], "container_kind string, capacity_tokens int")
    got = packing.assignment(d, "doc_id", "text", c)
    e = packing.encoding(TOK)
    assert {(r["container_kind"], r["doc_id"]): r["t"] for r in got.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("t")).collect()} == {(k, i): len(e.encode_ordinary(t)) for k in ("s", "m") for i, t in ((1, "hello world"), (4, "wort " * 5000))}


def test_groups(spark):
    base = [f"w{k}" for k in range(20)]
    rows = [("a", " ".join(base)), ("b", " ".join(base)), ("c", " ".join(base[:18] + ["x", "y"])), ("d", "quite another text about rivers"), ("e", " ".join(base[4:18] + ["x", "y", "p", "q", "r", "s"]))]
    m, li = neardup.join(spark.createDataFrame(rows, "id string, content string"), "id", "content")
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in neardup.grouped(m, li).collect()}
    assert set(got) == {"a", "b", "c", "e"} and len({g for g, _ in got.values()}) == 1
    assert {k: n for k, (_, n) in got.items()} == {"a": 2, "b": 2, "c": 3, "e": 1}
