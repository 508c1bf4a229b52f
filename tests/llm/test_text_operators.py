"""Normalisation, residue, leaks, truncation, boilerplate and spam on small fixtures."""

import random
import unicodedata

import numpy as np
import pytest

from gleaner.llm import boilerplate, leaks, normalise, residue, spam, truncation
from gleaner.llm.crf import Chain
from gleaner.llm.normalise import canonical
from gleaner.llm.trees import BaggedTrees


# ---------------------------------------------------------------- p7
@pytest.mark.parametrize(
    "a,b",
    [("Мaу plаn", "May plan"), ("ｔｈｅ end", "the end"), ("café", "café"), ("a b c", "a b c"), ("so­ft​ hy⁠phen﻿", "soft hyphen"), ("ﬁne ﬂow", "fine flow"), ("路上", "路上"), ("x\r\ny", "x\ny"), ("，", ",")],
)
def test_reads_the_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", [("Case", "case"), ("resume", "résumé"), ("v1", "v2"), ("a b", "ab"), ("a\nb", "a b"), ("x²", "x2"), ("👩‍💻", "👩💻"), ("①", "1")])
def test_reads_differently(a, b):
    assert canonical(a) != canonical(b)


def test_foreign_words_stay():
    assert canonical("«Вестра»") == "«Вестра»" and canonical("12 µg") == "12 μg" and canonical(None) is None and canonical(" ​ ") == ""
    assert canonical("ẞ", fold=True) == "ss"


def test_idempotent_on_random_strings():
    rng = random.Random(3)
    pool = "aZ é́ ​­ｗ ﬁ²\n\rоЅ中，👩‍"
    for _ in range(500):
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        once = canonical(s)
        assert canonical(once) == once and unicodedata.is_normalized("NFC", once)


def test_alike_pairs(spark):
    rows = [("1", "Same title", "x", 1), ("2", "Sаme title", "x", 1), ("2", "Sаme title", "x", 1), ("3", "Same title", " ", 2), ("4", None, None, 3), ("5", "same title", " ", 4), (None, "Same title", "y", 5), ("6", "word " * 20000, "z", 6), ("7", "word " * 20000, "z", 7)]
    d = spark.createDataFrame(rows, "id string, title string, author string, reading int")
    assert {tuple(r) for r in normalise.alike_pairs(d, "id", ["title", "author"]).collect()} == {("title", "1", "2"), ("title", "2", "3"), ("title", "6", "7")}
    assert normalise.alike_pairs(d.limit(0), "id", ["title"]).count() == 0
    assert normalise.canonical_columns(d, ["title"]).where("id = '2'").first()["title"] == "Same title"


# ---------------------------------------------------------------- p6
@pytest.mark.parametrize("s", ["{{ title }} rose", "Dear [YOUR NAME], hello", "%TITLE% - %SITE%", "据__DATE__消息，市议会开会。", "据undefined消息，市议会开会。", "Please enable JavaScript to view this page.", "404 Not Found", "lorem ipsum dolor sit amet", "TODO: write the lede", "请登录后查看全文。", "Zugriff verweigert. Kennung 1ebd4389", "asdf asdf test 12"])
def test_residue(s):
    assert residue.verdict(s, False) == 2


@pytest.mark.parametrize("s", ["", "  ", "The guide says `{{ user.name }}` is escaped.", "Writers want to stop pasting lorem ipsum into drafts, because clients read it. " * 4, "The court rejected the bid.", "Costs rose by 100 % in {May}.", "The result is undefined for zero."])
def test_no_residue(s):
    assert residue.verdict(s, False) == 0


def test_residue_titles_and_recurrence(spark):
    rows = [("a", "p1", "Untitled", "Fine text."), ("b", "p1", None, None), ("c", "p1", "Error in 3 parts", "x"), ("d", "p2", "Error in 4 parts", "y"), ("e", "p3", "Error in 5 parts", "z"), ("f", "p3", "A real story", "Please enable JavaScript to view this page."), ("f", "p3", "A real story", "Please enable JavaScript to view this page."), (None, "p", "Untitled", "")]
    d = spark.createDataFrame(rows, "id string, publisher string, title string, content string")
    got = {tuple(r)[:2] for r in residue.residue_fields(d, "id", "publisher", {"title": True, "content": False}).collect()}
    assert got == {("a", "title"), ("c", "title"), ("d", "title"), ("e", "title"), ("f", "content")}
    assert residue.residue_fields(d.limit(0), "id", "publisher", {"title": True}).count() == 0


@pytest.mark.parametrize("text", ["The council met. " * 300 + "lorem ipsum dolor sit amet " * 2000, "sed eiusmod tempor incididunt labore magna aliqua " * 120])
def test_filler_of_long_texts(text):
    assert residue.filler(text) and residue.verdict(text, False) == 2 and not residue.filler("The council met in May and sold the archive. " * 200)


def test_messages_recur_without_their_phrases(spark, monkeypatch):
    """With no phrase known, notices are told by recurrence across sources under unrelated titles; a reprint keeps its title."""
    import re

    monkeypatch.setattr(residue, "STRONG", re.compile("(?!)"))
    notice = "Your browser was blocked. Request %d could not be served. Reload the page. " * 20
    rows = [(f"n{k}", f"p{k}", f"Rain over {t}", notice % ((k,) * 20)) for k, t in enumerate(("Oslo", "Bern", "Lima", "Kyiv"))]
    rows += [(f"s{k}", f"p{k}", "Browser wars", "A browser was blocked in court. Requests were refused.") for k in range(5)]
    rows += [(f"l{k}", f"p{k}", f"Talk {t}", "One browser was blocked. " + "The council met and sold the archive to the town. " * 9) for k, t in enumerate(("a", "b", "c"))]
    d = spark.createDataFrame(rows, "id string, publisher string, title string, content string")
    got = residue.residue_fields(d, "id", "publisher", {"title": True, "content": False}).where("field_name = 'content'").collect()
    assert {(r["id"], r["sure"], r["sources"]) for r in got} == {(f"n{k}", False, 4) for k in range(4)}


# ---------------------------------------------------------------- p9
def brute_longest(doc, passage):
    best = 0
    for i in range(len(doc)):
        for j in range(len(passage)):
            k = 0
            while i + k < len(doc) and j + k < len(passage) and doc[i + k] == passage[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_automaton_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        ps = [[rng.choice("abcd") for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        doc = [rng.choice("abcde") for _ in range(rng.randrange(20))]
        a = leaks.Automaton(list(enumerate(ps)), 1)
        got = max([n for _, n, _ in a.matches(a.numbers(doc))], default=0)
        assert got == max(brute_longest(doc, p) for p in ps)
        for end, n, state in a.matches(a.numbers(doc)):
            w = doc[end - n + 1 : end + 1]
            for no, pos in a.ends[state]:
                assert ps[no][pos - n + 1 : pos + 1] == w


def test_leaks(spark):
    words = [f"w{k}" for k in range(40)]
    p = " ".join(words)
    noise = " ".join(f"n{k}" for k in range(300))
    changed = words[:]
    changed[10] = "other"
    docs = [(1, noise + " " + p.upper() + " " + noise), (2, " ".join(words[:25])), (3, " ".join(words[:12])), (4, " ".join(changed[:12]) + ",\nan inserted line here\n" + " ".join(changed[12:])), (5, " ".join(words[20:] + words[:20])), (6, None), (7, ""), (8, " ".join(words[:10]) + " " + noise + " " + " ".join(words[30:])), (1, p)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as covered")
    e = spark.createDataFrame([(9, p), (9, p), (10, None), (11, " ")], "eval_id long, passage string")
    got = {(r["doc_id"], r["eval_id"]) for r in leaks.leaks(d, "doc_id", "text", e, "eval_id", "passage").collect()}
    assert got == {(1, 9), (2, 9), (4, 9), (5, 9)}
    assert {(r["doc_id"], r["eval_id"]) for r in leaks.leaks(d, "doc_id", "text", e.union(spark.createDataFrame([(12, noise)], "a long, b string")), "eval_id", "passage", block=50).where("eval_id = 9").collect()} == got
    assert leaks.leaks(d.limit(0), "doc_id", "text", e, "eval_id", "passage").count() == 0


# ---------------------------------------------------------------- p3
def page(rng, furniture=True):
    body = [" ".join(rng.choice("the council paid for a new bridge over river and town".split()) for _ in range(rng.randrange(12, 30))).capitalize() + "." for _ in range(rng.randrange(2, 6))]
    if not furniture:
        return body, [0] * len(body)
    top = ["Home · Login · Events · Markets", "We use cookies to keep Site running and to measure visits. Accept all | Settings"]
    end = ["Most read", "» Rain over town as Works stalls", "» Why Labs left the river", "© 2024 Site. All rights reserved."]
    return top + body + end, [1] * 2 + [0] * len(body) + [1] * 4


def test_crf_learns_and_decodes_like_enumeration():
    rng = random.Random(2)
    pages = [page(rng, k % 3 > 0) for k in range(120)]
    chain = boilerplate.fit_chain(["\n".join(p) for p, _ in pages[:80]])
    right = total = 0
    for lines, y in pages[80:]:
        f, e = boilerplate.page_feats(lines)
        got = chain.decode(chain.emissions(f), e)
        right, total = right + sum(a == b for a, b in zip(got, y)), total + len(y)
    assert right / total > 0.98
    # Viterbi against all label sequences
    c = Chain(6)
    r = np.random.default_rng(0)
    c.trans, c.start, c.end = r.normal(size=(6, 2, 2)), r.normal(size=2), r.normal(size=2)
    s, edge = r.normal(size=7), r.integers(0, 6, 7).tolist()

    def score(y):
        return c.start[y[0]] + c.end[y[-1]] + sum(s[t] * y[t] for t in range(7)) + sum(c.trans[edge[t], y[t - 1], y[t]] for t in range(1, 7))

    import itertools

    assert tuple(c.decode(s, edge)) == max(itertools.product((0, 1), repeat=7), key=score)


def test_furniture_lines(spark):
    rng = random.Random(1)
    texts = ["\n".join(page(rng)[0]) for _ in range(60)]
    d = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("n", None), ("e", ""), ("b", " \n "), ("long", "A plain sentence here. " * 30000), ("0", texts[0])], "id string, content string").selectExpr("id", "content", "id as rec_id", "1 as line_no")
    model = boilerplate.fit([(d.select("id", "content"), "id", "content", None)])
    got = {(r["rec_id"], r["line_no"]) for r in boilerplate.furniture_lines(d, "id", "content", "t", model, True).collect()}
    n = len(texts[0].split("\n"))
    assert {k for i, k in got if i == "0"} == {1, 2, n - 3, n - 2, n - 1, n}
    assert not [1 for i, _ in got if i in ("n", "e", "b", "long")]
    assert boilerplate.furniture_lines(d.limit(0), "id", "content", "t", boilerplate.fit([(d.limit(0), "id", "content", None)]), False).count() == 0


def test_furniture_without_its_phrases(spark, monkeypatch):
    """Furniture that no seed knows is learnt from its recurrence; a DOM's tags are features too."""
    import re

    rng = random.Random(4)
    top, end = ["Alpha ~ Beta ~ Gamma zone", "Zap the quux to wibble 12 frobs"], ["Wobble your flim here", "Blip 2024 Flum and sons"]
    hidden = {x for x in top + end}
    monkeypatch.setattr(boilerplate, "SURE", re.compile("(?!)"))
    monkeypatch.setattr(boilerplate, "SECTIONS", set())
    rows = []
    for k in range(120):
        body = page(rng, False)[0]
        rows.append((f"r{k}", "\n".join((rng.sample(top, 1) if k % 3 else []) + body + (rng.sample(end, 1 + k % 2) if k % 4 else []))))
    d = spark.createDataFrame(rows, "id string, content string")
    model = boilerplate.fit([(d, "id", "content", None)])
    got = {(r["rec_id"], r["line_no"]) for r in boilerplate.furniture_lines(d, "id", "content", "t", model, True).collect()}
    want = {(i, k) for i, t in rows for k, x in enumerate(t.split("\n"), 1) if x in hidden}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)
    f, _ = boilerplate.page_feats(["A line.", "Menu"], ["html/body/article/p", "html/body/nav/li"])
    assert boilerplate._at("tagnav") in f[1] and boilerplate._at("tagnav") not in f[0]


def test_dom_blocks_and_tags(spark):
    no, texts, tags = boilerplate.dom_blocks("<html><head><title>x</title></head><body><nav><ul><li>Home</li><li><a href='/'>News</a></li></ul></nav><article><p>Some <b>bold</b> text.<br>More.</p></article><script>no()</script></body>")
    assert (no, texts) == ([1, 2, 3, 4], ["Home", "News", "Some bold text.", "More."]) and tags[0] == "html/body/nav/ul/li" and tags[2] == "html/body/article/p"
    assert boilerplate.dom_blocks("") == ([], [], []) and boilerplate.dom_blocks("<p>open <div>x")[1] == ["open", "x"]
    # furniture of one page alone, of any words: only its tags give it away
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(150):
        nav = "".join(f"<li>{x}</li>" for x in (["Home", "Contact us now"] if k < 100 else [word(), word() + " " + word()]))
        body = "".join(f"<p>{x}</p>" for x in page(rng, False)[0])
        rows.append((f"r{k}", f"<body><nav>{nav}</nav><article>{body}<p>{word()} {word()}</p></article></body>"))
    d = spark.createDataFrame(rows, "id string, html string")
    model = boilerplate.fit([(d.where("cast(substr(id, 2) as int) < 60"), "id", "html", None)], blocks=boilerplate.dom_blocks)
    got = {(r["rec_id"], r["line_no"]) for r in boilerplate.furniture_lines(d, "id", "html", "t", model, False).collect()}
    late = {x for x in got if int(x[0][1:]) >= 100}
    assert len(late & {(f"r{k}", n) for k in range(100, 150) for n in (1, 2)}) >= 90 and len(late) <= 105


# ---------------------------------------------------------------- p4
def story(rng):
    s = lambda: f"The {rng.choice(['council', 'court', 'vendor'])} {rng.choice(['closed', 'opened', 'sold'])} the {rng.choice(['bridge', 'harbour', 'archive'])} in {rng.choice(['May', 'June', 'July'])} after {rng.randrange(2, 90)} weeks of {rng.choice(['testing', 'talks', 'delay'])}."
    return "\n".join(" ".join(s() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 5)))


def test_cut_texts(spark):
    rng = random.Random(8)
    whole = [story(rng) for _ in range(200)]
    cut = [t[: rng.randrange(len(t) // 2, len(t) - 12)].rstrip() for t in whole[:60]]
    cut = [t if t[-1] not in ".0123456789" else t[:-3] for t in cut]
    rows = [(f"w{k}", t) for k, t in enumerate(whole)] + [(f"c{k}", t) for k, t in enumerate(cut)]
    rows += [(f"e{k}", t + "\ncheers...") for k, t in enumerate(whole[:8])] + [(f"s{k}", t[:-1]) for k, t in enumerate(whole[:20])] + [(f"m{k}", t[: len(t) // 2] + " […]") for k, t in enumerate(whole[:9])] + [("n", None), ("b", " "), ("c0", cut[0])]
    d = spark.createDataFrame(rows, "id string, t string").selectExpr("id", "t", "1 as verdict", "'x' as line")
    model, trees = truncation.fit([(d.select("id", "t"), "id", "t")])
    got = {r["rec_id"] for r in truncation.cut_records([(d, "id", "t", "x")], model, trees, None).collect()}
    assert sum(f"c{k}" in got for k in range(60)) >= 54
    assert not [i for i in got if i[0] in "wenb"] and {f"m{k}" for k in range(9)} <= got
    assert sum(f"s{k}" in got for k in range(20)) <= 2
    m, t = truncation.fit([(d.limit(0), "id", "t")])
    assert truncation.cut_records([(d.limit(0), "id", "t", "x")], m, t, None).count() == 0


def cut_ids(spark, rows, fitted="true"):
    d = spark.createDataFrame(rows, "id string, t string")
    model, trees = truncation.fit([(d.where(fitted), "id", "t")])
    return {r["rec_id"] for r in truncation.cut_records([(d, "id", "t", "x")], model, trees, None).collect()}


def test_cut_in_a_few_words(spark):
    rng = random.Random(3)
    rows = [(f"w{k}", story(rng)) for k in range(60)]
    # two texts cut in the same stub, one after a whole word, one in a tag
    rows += [(f"c{k}", story(rng) + "\nThe coun") for k in range(2)] + [("c2", story(rng) + "\nThe court")]
    rows += [(f"t{k}", story(rng) + f"\n#harbour #bridge{'s' * (k % 2)} #v{k}") for k in range(8)] + [("c3", story(rng) + "\n#harbour #bri"), ("t8", story(rng) + "\n#v1 #bridge")]
    # complete: names, also at the head of a few lines, and notes
    rows += [(f"n{k}", story(rng) + f"\nAda Bole{k}") for k in range(9)] + [("m0", "Ada Bole, Townholm\n" + story(rng)), ("n9", story(rng) + "\nAda Bole"), ("n10", story(rng) + "\nsolved")]
    assert {i for i in cut_ids(spark, rows) if i[0] in "cntm"} == {"c0", "c1", "c2", "c3"}


def test_copies_never_excuse_a_cut(spark):
    rng = random.Random(5)
    rows = [(f"w{k}", story(rng)) for k in range(200)]
    a, b = story(rng), story(rng)
    rows += [(f"c{k}", a + "\nThe council closed the bridge in") for k in range(12)] + [(f"d{k}", b + "\nThe council clo...") for k in range(12)]
    # a meant ending of two different texts
    rows += [(f"e{k}", story(rng) + "\nTo be continued...") for k in range(2)]
    assert {i for i in cut_ids(spark, rows, "id like 'w%'") if i[0] != "w"} == {f"{x}{k}" for x in "cd" for k in range(12)}


def test_removed_spans(spark):
    passage = "the seventh lamp of the harbour was lit by a keeper who had never seen the sea before"
    long_ = " ".join(f"word{k}" for k in range(120))
    body = "Something else entirely stands here.\n"
    d = spark.createDataFrame([(1, body + passage.upper() + ", indeed. And more follows."), (2, body * 30), (3, None), (4, ""), (5, body + " ".join(f"word{k}" for k in range(55)) + " end"), (1, body + passage.upper() + ", indeed. And more follows."), (6, passage[:30])], "k long, t string")
    e = spark.createDataFrame([(7, passage), (8, long_), (9, None)], "i long, p string")
    got = {r["k"]: (r["spans"], r["removed_tokens"], r["text"]) for r in leaks.removed(d, "k", "t", e, "i", "p").collect()}
    assert got == {1: (1, 18, body + "indeed. And more follows."), 5: (1, 55, body + "end")}
    assert leaks.removed(d.limit(0), "k", "t", e, "i", "p").count() == 0


# ---------------------------------------------------------------- p10
def test_host_moves_a_page():
    """A page in doubt goes with its host; one that is clear does not."""
    from gleaner.llm import spam as S

    r = np.random.default_rng(2)
    label = np.repeat([1, 0], 200)
    page = np.where(label == 1, r.normal(1.0, 2.0, 400), r.normal(-1.0, 2.0, 400))
    host = np.where(label == 1, r.normal(2.0, 1.0, 400), r.normal(-2.0, 1.0, 400))
    w = S.weights(page, host, label)
    assert w[2] > 0.5
    doubt = float(S.logit(np.array([0.4]))[0])
    assert w @ [1, doubt, 2.5] > 0 > w @ [1, doubt, -1.0] and w @ [1, 6.9, -0.5] > 0
    assert S.weights(page, np.zeros(400), np.ones(400)).tolist() == S.BELIEF.tolist()


def test_trees_separate():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.5)).astype(int)
    m = BaggedTrees(x[:300], y[:300])
    assert ((m.predict(x[300:]) > 0.5) == y[300:]).mean() > 0.93
    assert BaggedTrees(np.zeros((0, 5)), np.zeros(0)).predict(x[:3]).tolist() == [0, 0, 0]


def test_spam(spark):
    rng = random.Random(6)
    heap = lambda: " ".join(rng.choice("cheap buy top store price deal outlet sale".split()) for _ in range(90))
    urls = lambda: "\n".join(f"https://a{rng.randrange(999)}.example/x/{rng.randrange(9999)}" for _ in range(20))
    nouns = [a + b for a in "bal cor dun fer gil hor".split() for b in "an ex ith om ury ace".split()]
    prose = lambda: " ".join(f"The {rng.choice(nouns)} of {rng.choice(nouns)} {rng.choice(nouns)} a {rng.choice(nouns)} and {rng.choice(nouns)} in the {rng.choice(nouns)}." for _ in range(rng.randrange(3, 9)))
    rows = [(k, prose(), "good.example") for k in range(80)] + [(100 + k, heap(), "bad.example") for k in range(20)] + [(200 + k, urls(), None) for k in range(20)]
    rows += [(300, None, "x"), (301, " ", "x"), (0, rows[0][1], "good.example"), (302, prose() + "\n[1] https://a.example/p/1\n[2] https://b.example/p/2", "good.example")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as page", "'y' as host")
    got = {r["doc_id"] for r in spam.scored(d, "doc_id", "text", "source").where("score > 0.5").collect()}
    assert got == set(range(100, 120)) | set(range(200, 220))
    assert spam.scored(d.limit(0), "doc_id", "text", "source").count() == 0
