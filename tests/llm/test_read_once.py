"""Pages are read once for the fit and the decoding; steps over arrays give what the scalar ones do."""

import random

import numpy as np

from gleaner.llm import boilerplate, residue, spam, truncation
from gleaner.llm.crf import Chain, places

ODD = ["a", "#tag x. y", "[1] foo", ")", 'Done.")', '."', "𝒜𝒷𝒸 𝟙 abcdefgh ijk lmnop q r s", "😀 one two three four", "- a b c d e. f g", "他们说。好", ".", "。", "x. y", "* a", "http://a.b c", "² Ⅷ x ٣ 12", "İstanbul ist groß", "We met (at last) at the gate of the old town. Nobody knew why", "Home | News  | Sport", "All rights reserved."]


def some_texts(n=150):
    rng = random.Random(5)
    menu = ["Home | News | Sport", "Follow us on the usual networks", "[3] a source", "A sentence that is printed twice, on two pages, and on no third one.", *ODD]
    return [f"{rng.choice(menu)}\nThe {k}th bridge of {'abcdefg'[k % 7] * (1 + k // 7)} was closed for a number of weeks{'.' if k % 3 else ''}\n{rng.choice(menu)}" for k in range(n)]


def test_read_pages_give_the_same_bodies(spark):
    """Copies within and across columns, blanks and nulls: bodies from the features of the fit are those from the texts."""
    texts = some_texts()
    a = spark.createDataFrame([(str(k), t, f"h{k % 3}") for k, t in enumerate(texts[:90] + texts[:5] + [None, " ", "\n"])], "id string, t string, host string")
    b = spark.createDataFrame([(str(k), t, None) for k, t in enumerate(texts[80:] + texts[140:])], "id string, t string, host string")
    tables = [(a, "id", "t", "host"), (b, "id", "t", "host")]
    read = boilerplate.read_pages(tables)
    stripper = boilerplate.fit_whole(tables, read=read)
    assert np.allclose(stripper.chain.vector(), boilerplate.fit_whole(tables).chain.vector()) and stripper.chain.vector().any()
    got, want = ([tuple(r) for r in truncation.bodies([(a, "t"), (b, "t")], stripper, 1, True, r).orderBy("col", "h").collect()] for r in (read, None))
    assert got == want and len(got) == 90 + 70


def test_hosts_of_copies_count(spark):
    """A block of two hosts is not of one host, though copies of its page meet in one batch."""
    menu, texts = "Contact the desk of the paper by letter, or by telephone.", [f"{c * 60} was closed for a number of weeks." for c in "abcdefgh"]
    d = spark.createDataFrame([(str(k), f"{menu}\n{t}", h) for k, t in enumerate(texts) for h in ("h1", "h2")], "id string, t string, host string").coalesce(1)
    seen = []
    fit = boilerplate.fit_chain_whole
    boilerplate.fit_chain_whole = lambda pages, edges: seen.extend(np.frombuffer(r["y"], dtype=np.int8)[0] for r in pages.collect()) or Chain(edges)
    try:
        boilerplate.fit_whole([(d, "id", "t", "host")])
    finally:
        boilerplate.fit_chain_whole = fit
    assert len(seen) == 8 and 1 not in seen  # prose must recur more widely than this, unless on one host


def test_paths_are_viterbi():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 9, 60)
    c = Chain(6)
    c.trans, c.start, c.end = rng.normal(size=(6, 2, 2)), rng.normal(size=2), rng.normal(size=2)
    score, edge = rng.normal(size=size.sum()), rng.integers(0, 6, size.sum())
    at, live = places(size)
    got = np.empty(len(score), dtype=int)
    got[at] = c.paths(score[at], edge[at], live)
    ends = np.cumsum(size)
    assert got.tolist() == [v for i, j in zip(ends - size, ends) for v in c.decode(score[i:j], edge[i:j].tolist())]


def test_shapes_of_lines():
    lines = ODD + [x for t in some_texts(60) for x in t.split("\n")] + ["w" * 100 + " x", "a b " * 60, "词" * 70]
    page = np.arange(len(lines)) % 4
    got = truncation._Shapes(lines, page)
    assert np.repeat(got.partial.ravel(), got.runs).tolist() == np.concatenate([truncation._partial_kinds(x, int(p)) for x, p in zip(lines, page)]).tolist()
    assert got.end.tolist() == np.concatenate([truncation._ends(x) for x in lines]).tolist()
    assert got.kind.tolist() == [truncation._line_kind(x, int(p)) for x, p in zip(lines, page)]
    assert got.done.tolist() == [bool(truncation._DONE.search(x)) for x in lines] == [truncation._done(x) for x in lines]
    assert got.codes.tolist() == truncation._codes(lines).tolist()


def test_quick_looks_miss_nothing():
    """Each shortcut against the pattern it stands for."""
    for x in ODD + ["10.1.2020 at www.a.org 0x1f 3,500", "see ab12cdef9 now", "Text. all rights reserved"]:
        assert residue.mask(x) == " ".join(residue._NUM.sub("0", residue._HEX.sub("H", residue._DATE.sub("D", residue._URL.sub("A", x)))).casefold().split())
        assert boilerplate._words(x) == boilerplate._WORD.findall(x)
        assert boilerplate._separated(x) == bool(boilerplate._SEP.search(x))
        assert bool(boilerplate.SURE.match(x) or boilerplate._TAIL.search(x[-40:])) == bool(boilerplate.SURE.search(x))
        assert ("\t" in x or bool(boilerplate.FORMULA.match(x))) == bool(boilerplate.FORMULA.search(x))
        assert spam._few(x * 9) == (len(spam._TOKEN.findall(x * 9)) <= 4)
        f = dict(zip(spam.FEATURES, spam.features(x)))
        assert f["digits"] == sum(map(str.isdigit, x)) / len(x) or "http" in x
        assert f["cap"] == sum(map(str.isupper, x)) / len(x) or "http" in x
    bits = np.zeros(1 << truncation.BITS - 5, dtype=np.uint32)
    for s in ("The 0th", "我们", "a"):
        bits[truncation._slot(s) >> 5] |= np.uint32(1 << (truncation._slot(s) & 31))
    assert [(i, k) for i, k in zip(*truncation._starts(["The 0th day", "我们说", "x", "abc"], bits))] == [(0, 7), (1, 2), (3, 1)]


def test_notices_in_longer_texts():
    story = "The council of the town met to talk about the bridge over the river. " * 9
    assert residue.verdict(f"{story}Then an error was found in the sum.", False) == 0
    assert residue.verdict("Too many requests. Slow down and retry later. The page is here.", False) == 2
    assert residue.verdict(f"404 not found\n{story}Too many requests, they said.", False) == 2
