"""Models of problems 2 and 4 rest on every row, not on samples."""

import random
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import boilerplate, common, queries, truncation
from gleaner.llm.crf import DIM, Chain
from gleaner.llm.crf import fit_whole as fit_chain
from gleaner.llm.trees import fit_whole as fit_trees


@pytest.fixture
def no_samples(monkeypatch):
    def refuse(*_):
        raise AssertionError("rows were sampled")

    for m in (common, truncation, boilerplate):
        if hasattr(m, "sample_rows"):
            monkeypatch.setattr(m, "sample_rows", refuse)


def test_slope_is_the_gradient():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=50), np.zeros(DIM - 50), rng.normal(size=28)])
    size = np.array([3, 1, 7, 4])
    n = rng.integers(1, 5, size.sum())
    page = rng.integers(0, 50, n.sum()), n, rng.integers(0, 6, size.sum()), rng.integers(-1, 2, size.sum()), size
    g = Chain(6).load(x).slope(*page)[1]
    for j in (3, 7, 20, DIM + 4, DIM + 13, *range(DIM + 24, DIM + 28)):
        d = np.zeros_like(x)
        d[j] = 1e-5
        assert (Chain(6).load(x + d).slope(*page)[0] - Chain(6).load(x - d).slope(*page)[0]) / 2e-5 == pytest.approx(g[j], abs=1e-5)


def test_every_page_trains(spark, monkeypatch, no_samples):
    """More pages than a sample holds, their labels against recurrence counted here; a copy counts once."""
    rng = random.Random(2)
    menu = ["Home | News | Sport", "Follow us on the usual networks", "Read all about it", "[3] a source", "A sentence that is printed twice, on two pages, and on no third one."]
    texts = [f"{rng.choice(menu)}\nThe {k}th bridge of {'abcdefg'[k % 7] * (1 + k // 7)} was closed for a number of weeks.\n{rng.choice(menu[:4])}" for k in range(2300)] + ["One line", " ", None, "\n"]
    kept = []
    monkeypatch.setattr(boilerplate, "fit_chain_whole", lambda pages, edges: kept.extend(pages.collect()) or Chain(edges))
    d = spark.createDataFrame([(str(k), t, f"h{k % 3}") for k, t in enumerate(texts + texts[:9])], "id string, t string, host string")
    boilerplate.fit_whole([(d, "id", "t", "host")])
    lines = [boilerplate.split_lines(t or "")[1] for t in texts]
    wanted = {k for x in lines for b in x for k in boilerplate.block_keys(b)}
    n, pages = boilerplate.spread_of([(d, "t", "host")], wanted)
    want = Counter()
    for x in lines:
        if x:
            f, e = boilerplate.page_feats(x)
            want[tuple(tuple(sorted(g)) for g in f), tuple(e), tuple(boilerplate.labels(x, n, pages))] += 1
    got = Counter()
    for r in kept:
        f, n, e, y = (np.frombuffer(r[c], dtype=t) for c, t in (("f", np.uint16), ("n", np.uint32), ("e", np.uint8), ("y", np.int8)))
        got[tuple(tuple(sorted(g.tolist())) for g in np.split(f, np.cumsum(n)[:-1])), tuple(e.tolist()), tuple(y.tolist())] += 1
    assert got == want and pages > boilerplate.SAMPLE


def test_whole_chain_fits(spark):
    """The steps end at a place where the gradient over all pages is near none; no pages give no weights."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        y = rng.integers(0, 2, 4).astype(np.int8)
        f = np.column_stack([np.where(rng.random(4) < 0.9, y, 1 - y), 2 + rng.integers(0, 5, 4)]).astype(np.uint16)
        rows.append((bytearray(f.tobytes()), bytearray(np.full(4, 2, np.uint32).tobytes()), bytearray(bytes([0, 4, 4, 4])), bytearray(y.tobytes())))
    d = spark.createDataFrame(rows, "f binary, n binary, e binary, y binary")
    c = fit_chain(d.repartition(3), 6, steps=40, l2=1e-2)
    f, n, e, y = (np.concatenate([np.frombuffer(bytes(r[k]), dtype=t) for r in rows]) for k, t in enumerate((np.uint16, np.uint32, np.uint8, np.int8)))
    seen = np.concatenate([np.bincount(f, minlength=DIM), np.full(24, 1200), np.full(4, 300)])
    g = (c.slope(f.astype(int), n, e.astype(int), y, np.full(300, 4))[1] - 1e-2 * seen * c.vector()) / 300
    assert np.abs(g).max() < 2e-3 and c.w[1] - c.w[0] > 1
    assert not fit_chain(d.limit(0), 6).vector().any()


def test_every_value_is_counted(spark, no_samples):
    """Contexts of a last line over more values than a sample holds, against counting by hand; a copy counts once."""
    texts = [f"We met at the gate {'x' * (k % 40)}{'y' * (k // 40)}\nthe end of the bridge was in the bri" for k in range(2200)] + ["All went home.", " ", None]
    d = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts + texts[:5])], "id string, t string")
    model, _ = truncation.fit([(d, "id", "t")])
    asks = model.rows.where("keys IS NOT NULL")
    seen, totals, _, n = model.counts(asks)
    assert n == 2201 and asks.count() == 2200
    one = asks.first()
    got = {r["k"]: (r["e"], r["c"]) for r in seen.collect()}
    want: dict[int, list[int]] = {}
    for r in model.rows.collect():
        *head, last = r["lines"].split("\n")
        for x, open_ in [(x, False) for x in head] + [(last, r["open"])]:
            kinds, ends = truncation._partial_kinds(x, r["page"]), truncation._ends(x)
            for k in range(len(x) + 1 - open_):
                if int(kinds[k]) + r["stratum"] == one["salt"]:
                    s = "\n" + x[:k]
                    for at, o in enumerate(truncation.ORDERS[: len(one["keys"])]):
                        if s.endswith(("\n" + one["last"])[-o:]) and len(s) >= o:
                            want.setdefault(one["keys"][at], [0, 0])[0 if ends[k] else 1] += 1
    assert {k: got[k] for k in want} == {k: (e, c if c > 1 else 0) for k, (e, c) in want.items()} and len(want) > 2


def test_whole_trees_separate(spark):
    """Alike on any split of the rows; one class or no rows give a constant."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.5)).astype(int)
    d = spark.createDataFrame([(k, x[k].tolist(), int(y[k])) for k in range(400)], "k long, x array<double>, y int")
    m = fit_trees(d)
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.93
    assert (fit_trees(d.repartition(5)).predict(x) == m.predict(x)).all()
    assert fit_trees(d.limit(0)).predict(x[:2]).tolist() == [0, 0] and fit_trees(d.where("y = 1")).predict(x[:2]).tolist() == [1, 1]


def test_spam_trees_see_every_page(spark):
    """More labelled pages than a sample holds reach the fit."""
    rng = random.Random(3)
    rows = [(str(k), " ".join(rng.choice("cheap buy top store price deal outlet sale".split()) for _ in range(90)) + f" {k}") for k in range(1900)]
    nouns = [a + b for a in "bal cor dun fer gil hor".split() for b in "an ex ith om ury ace".split()]
    rows += [(f"p{k}", " ".join(f"The {rng.choice(nouns)} of {rng.choice(nouns)} {rng.choice(nouns)} a {rng.choice(nouns)} and {rng.choice(nouns)} in the {rng.choice(nouns)}." for _ in range(rng.randrange(3, 9)))) for k in range(300)]
    d = spark.createDataFrame(rows, "id string, t string")
    seen = []
    fit = truncation.fit_trees
    truncation.fit_trees = lambda t: seen.append(t.groupBy("y").count().collect()) or fit(t)
    try:
        _, trees = truncation.fit([(d, "id", "t")], None, 0)
    finally:
        truncation.fit_trees = fit
    y = truncation.spam.weak_label(np.array([truncation.spam.features(t) for _, t in rows]))
    assert {r["y"]: r["count"] for r in seen[0]} == {1: int((y == 1).sum()), 0: int((y == 0).sum())} and (y == 1).sum() > 1800 and (y == 0).sum() > 200
    f = lambda k: np.array([truncation.spam.features(rows[k][1])])
    assert trees.predict(f(0))[0] > 0.9 and trees.predict(f(1950))[0] < 0.1


@pytest.mark.parametrize("name", ["p2_found", "p4_found"])
def test_no_sample_decides(spark, no_samples, name):
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
