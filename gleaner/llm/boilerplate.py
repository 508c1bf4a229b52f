"""Page boilerplate mixed with main content.

A page is a sequence of leaf blocks (its non-blank lines, or the leaves of a DOM
with their ancestor tags). A linear-chain CRF gives each block body or furniture
from text features (words, separators, length, end of sentence), tag features
(bullet, heading, place in a list and the list's heading, ancestor tags where a
DOM is given) and its neighbours; Viterbi decides, nothing after it does.

Training pages are a bounded sample (``sample`` pages a table, read whole). Their
labels come from recurrence over all pages: a block whose text, or each of whose
separated parts, stands on many pages with different bodies is furniture, unless
it has the form of a text's own formulas (greetings, sign-offs, common headings,
references, tags); a sentence of one page alone is body; seeds (``SURE``,
``STORIES``) label too, so that small tables have labels; everything else is
left open and summed over in training.

Defined cases: null or blank texts have no lines; a page of one line is decoded
as any other; pages that are residue (p6) or spam (p10) have no furniture; rows
with a repeated key give the same lines once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import residue, spam
from gleaner.llm.common import listed, per_batch, sample_rows, utf8, within_listed
from gleaner.llm.crf import DIM, OPEN, PAGES, Chain, places
from gleaner.llm.crf import fit_whole as fit_chain_whole
from gleaner.llm.trees import BaggedTrees
from gleaner.session import cut, drop

SAMPLE = 2000
LONG = 22
WIDE = 3e-4  # share of all pages a block stands on to recur, at least FEW pages
FEW = 4
PROSE = 6
# fixed values: phrases of page furniture, seeds that label training pages and nothing else
SURE = re.compile(
    r"^(?:follow us on|report an error|back to top$|get the app|advertisement$|listen to this article|sign up for (?:the|our)\b.*(?:letter|newsletter)|support .{2,50} from \d+ a month|questions\? write to"
    r"|© ?\d{4}|(?:we use|this site (?:uses|sets)) |by staying on this site|you have \d+ free articles|your privacy:|.{2,60} and \d+ partners store|.{2,60} is published in \d{4} by|share +save +print"
    r"|terms +\| |about us · |(?:read also|don't miss|see more): |fehler auf dieser seite|nach oben$|anzeige$|.{2,60} und \d+ partner speichern|wir verwenden cookies|mit der nutzung dieser seite|noch \d+ freie artikel"
    r"|jetzt den newsletter|teilen +merken|agb +\| |über uns · |(?:lesen sie auch|auch interessant|mehr dazu|siehe auch): |volver arriba$|avisar de un error|publicidad$|usamos cookies|si sigue navegando|.{2,60} y \d+ socios guardan"
    r"|le quedan \d+ artículos|suscríbase al|compartir +guardar|términos +\| |quiénes somos · |(?:le puede interesar|lea también|también le interesa|ver más): |举报本页|返回顶部$|广告$|本站使用 ?cookie|继续浏览即表示|.{2,60}及\d+家合作方"
    r"|本月还可免费|订阅.{2,60}早报|分享 +收藏|条款 +\| |关于我们 · |(?:延伸阅读|推荐阅读|更多阅读|相关阅读|另请阅读)[：:]|联系.{0,6}编辑部|app ?下载|下载(?:客户端|应用)|.{0,40}cookies? (?:einstellungen|policy))"
    r"|(?:all rights reserved|alle rechte vorbehalten|todos los derechos reservados|版权所有)\.?$",
    re.I,
)
STORIES = re.compile(r"^(?:most read|related stories|trending now|editor's picks|more from .{2,60}|lo más leído|noticias relacionadas|más de .{2,60}|meistgelesen|mehr zum thema|mehr von .{2,60}|热门阅读|相关报道|更多.{2,60}内容)$", re.I)
# fixed values: section names of site navigation
SECTIONS = set(
    "home login log in events markets newsletters jobs technology contact search science world weather local sport sports video podcasts forum culture opinion archive business politics health travel"
    " start anmelden termine wirtschaft newsletter stellen technik kontakt suche wissen welt wetter lokales video podcasts forum kultur meinung archiv politik"
    " inicio entrar agenda economía boletines empleo tecnología contacto buscar ciencia mundo tiempo local deportes vídeo vídeos foro cultura opinión archivo política"
    " 首页 登录 活动 财经 订阅 招聘 科技 联系我们 搜索 科学 国际 天气 本地 体育 视频 播客 论坛 文化 评论 存档".split()
)
# fixed values: a text's own formulas, which recur though they are body
FORMULA = re.compile(
    r"^(?:hi|hello|hey|dear|hallo|liebe|hola|buenas|大家好|你好)\b.{0,60}$|^(?:大家好|你好)|^(?:cheers|thanks|thank you|regards|best|danke|gruß|gracias|saludos|谢谢)\b.{0,50}$|^(?:edit|update|ps|p\.s\.)\b|^(?:to be continued|and so)\b"
    r"|^(?:references|related work|changes|changelog|fixed|added|removed|known issues|notes|sources|summary|background|introduction|methods?|results|conclusions?|abstract|faq|questions?|answers?"
    r"|quellen|änderungen|behoben|bekannte probleme|zusammenfassung|hintergrund|verweise|referencias|cambios|corregido|problemas conocidos|resumen|fuentes|参考资料|参考文献|更新内容|已修复|已知问题|相关工作|摘要|背景|结论):?$"
    r"|^\[\d+\]|^https?://\S+$|^[#@]\S+(?:\s+[#@]\S+)*$|\t|^[\W\d]*$|^q\d*[:.]|^a\d*[:.]|^问[:：]|^答[:：]",
    re.I,
)
_SEP = re.compile(r" [·|/>›»•] |  +")
_STOP = re.compile(r"[.!?。！？…:：]$")
_BULLET = re.compile(r"^([*\-–»>•·#]+|\d+[.)]|\[\d+\])\s+")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+|\d+")


_TAIL = re.compile(r"(?:all rights reserved|alle rechte vorbehalten|todos los derechos reservados|版权所有)\.?$", re.I)  # what SURE finds elsewhere than at the beginning


_LISTED_WORD = re.compile(rf"[一-鿿]|[{listed(re.compile(r'[^\W\d_一-鿿]').match)}]+|[{listed(re.compile(r'\d').match)}]+")


def _words(s: str) -> list[str]:
    """All of ``_WORD`` in a text."""
    return (_LISTED_WORD if within_listed(s) else _WORD).findall(s)


class _Kept(dict):
    """Values of a function, kept up to a number."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, x):
        if len(self) >= 1 << 16:
            self.clear()
        v = self[x] = self.make(x)
        return v


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & (DIM - 1)


_at = _Kept(_h).__getitem__
_UTF = _Kept(lambda w: w.encode("utf-8", "surrogatepass"))
_W = _Kept(lambda w: _h("w" + w))
_THEN = _Kept(lambda w: zlib.crc32(("2" + w + "_").encode("utf-8", "surrogatepass")))


def bullet(line: str) -> str:
    m = _BULLET.match(line)
    return "" if not m else "n" if m[1][0].isdigit() else "r" if m[1][0] == "[" else m[1][0]


@lru_cache(maxsize=50_000)
def _short_feats(line: str) -> bytes:
    """Features of a block by itself (short blocks; furniture recurs, so they are kept), two bytes each."""
    b = bullet(line)
    rest = _BULLET.sub("", line) if b else line
    words = [w if not w.isdigit() else "0" for w in _words(rest.lower())]
    parts = [p.strip().lower() for p in _SEP.split(rest)] if _separated(rest) else [rest.strip().lower()]
    seps = len(parts) - 1
    sect = sum(p in SECTIONS for p in parts)
    stop = bool(_STOP.search(line))
    plain = rest.split()
    caps = sum(w[0].isupper() for w in plain)
    n = len(words)
    size = "1" if n == 1 else "2" if n == 2 else "s" if n < 6 else "m" if n < 12 else "l"
    f = {_at("b" + b), _at("n" + size), _at(f"stop{stop}"), _at("sep" + str(min(seps, 3))), _at(f"sect{min(sect, 2)}{sect == len(parts)}"), _at(f"caps{int(4 * caps / max(1, len(plain)))}"), _at(f"b{b}n{size}{stop}")}
    if "http" in line or ".example" in line or "@" in line or "www." in line:
        f.add(_at("url"))
    if line[0] in "©#[":
        f.add(_at("c" + line[0]))
    f.update(map(_W.__getitem__, words))
    if words:
        crc, m = zlib.crc32, DIM - 1
        f.update([crc(_UTF[c], _THEN[a]) & m for a, c in zip(words, words[1:])])
        f.add(_h("first" + words[0]))
        f.add(_h("last" + words[-1]))
    f.add(_h("mask" + residue.mask(line)))
    return array("H", sorted(f)).tobytes()


def _separated(x: str) -> bool:
    """Whether ``_SEP`` is found."""
    return "  " in x or " | " in x or " · " in x or " / " in x or " • " in x or " > " in x or " › " in x or " » " in x


def page_feats(lines: list[str], tags: list[str] | None = None) -> tuple[list[list[int]], list[int]]:
    """(features, edge classes) of a page's non-blank, stripped lines; ``tags``: the ancestor tags of each, as ``html/body/nav/li``."""
    flat, n, edges = flat_feats(lines, tags)
    f, out, at = flat.tolist(), [], 0
    for k in n:
        out.append(f[at : at + k])
        at += k
    return out, edges


def flat_feats(lines: list[str], tags: list[str] | None = None) -> tuple[array, list[int], list[int]]:
    """:func:`page_feats` with the features of all lines in one array of two bytes each, and their number per line."""
    feats, counts, edges, done = array("H"), [], [], 0
    n = len(lines)
    kinds, bs = [], []
    for x in lines:
        b = bullet(x)
        bs.append(b)
        stop = bool(_STOP.search(x)) and not x.endswith("?")
        long = len(x) > 160 or (len(x) > 60 and x.count(" ") >= LONG) or (len(x) > 45 and "一" <= x[len(x) // 2] <= "鿿" and stop)
        kinds.append("L" if long else "S" if stop else "h")
    inside, head = 0, ""  # place within a run of unstopped lines of one form, and the heading it stands under
    for t, x in enumerate(lines):
        if t and kinds[t] == "h" and (inside and bs[t] == bs[t - 1] or not inside and kinds[t - 1] == "h" and not bs[t - 1]):
            if not inside:
                head = lines[t - 1].lower()
            inside += 1
        else:
            inside = 0
        up, down = min(t, 4) if t < 8 else 8, min(n - 1 - t, 4) if n - 1 - t < 8 else 8
        k = kinds[t]
        if k == "L":
            b = bs[t]
            low = x.lower()
            f = [_at("long"), _at("longb" + b), _at("longu" + str("http" in x or "cookie" in low)), _h("first" + x.split(" ", 1)[0].lower()[:20])]
            f += map(_W.__getitem__, set(_words(low)))
        else:
            feats.frombytes(_short_feats(x))
            f = []
        before, after = (kinds[t - 1] + bs[t - 1] if t else "^"), (kinds[t + 1] + bs[t + 1] if t + 1 < n else "$")
        if inside:
            f += [_at(f"inside{min(inside, 7)}"), _at("insideb" + bs[t]), _h("under" + head), *(_h("underw" + w) for w in _words(head)[:6])]
        if tags is not None:
            f += [_at("tag" + a) for a in set(tags[t].split("/"))]
            f.append(_at("leaf" + tags[t].rsplit("/", 1)[-1]))
        f += [_at("bias"), _at(f"up{up}{k}"), _at(f"down{down}{k}"), _at(f"pr{k}{bs[t]}{before}"), _at(f"nx{k}{bs[t]}{after}")]
        feats.extend(f)
        counts.append(len(feats) - done)
        done = len(feats)
        # edge class: no bullets, same bullet, bullet begins, bullet ends or changes; doubled for a plain short line after a plain short line
        if t == 0:
            edges.append(0)
        elif bs[t] and bs[t] == bs[t - 1]:
            edges.append(1)
        elif bs[t]:
            edges.append(2)
        elif bs[t - 1]:
            edges.append(3)
        else:
            edges.append(4 if k == "h" and kinds[t - 1] == "h" else 5 if k == "h" else 0)
    return feats, counts, edges


def _parts(line: str) -> list[str]:
    return [p for p in (q.strip().lower() for q in _SEP.split(line)) if p]


def block_keys(line: str) -> list[int]:
    """Hashes by which a block recurs: its text, and each of its separated parts; digits alike, without a bullet."""
    x = _DIGITS.sub("0", _BULLET.sub("", line).lower())
    parts = _parts(x) if _separated(x) else ()
    return [_line_hash(x)] + ([_line_hash(p) for p in parts] if len(parts) > 1 else [])


def _line_hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def split_lines(text: str) -> tuple[list[int], list[str]]:
    no, lines = [], []
    for k, x in enumerate(text.split("\n"), 1):
        x = x.strip()
        if x:
            no.append(k)
            lines.append(x)
    return no, lines


class _Leaves(HTMLParser):
    """Leaf blocks of a DOM: the text between block tags, each with its ancestor tags."""

    VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
    INLINE = {"a", "abbr", "b", "bdi", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var"}
    UNSEEN = {"script", "style", "template", "noscript", "head"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.text: list[str] = []
        self.out: list[tuple[str, str]] = []

    def flush(self) -> None:
        t = " ".join("".join(self.text).split())
        if t:
            self.out.append((t, "/".join(x for x in self.open if x not in self.INLINE)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            if tag in ("br", "hr"):
                self.flush()
            return
        if tag not in self.INLINE:
            self.flush()
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.flush()
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not any(x in self.UNSEEN for x in self.open):
            self.text.append(data)


def dom_blocks(html: str) -> tuple[list[int], list[str], list[str] | None]:
    """(numbers, texts, ancestor tags) of a page's leaf blocks, counted from 1; broken markup gives what could be read."""
    p = _Leaves()
    try:
        p.feed(html)
        p.close()
    except (AssertionError, ValueError):
        pass
    p.flush()
    return list(range(1, len(p.out) + 1)), [t for t, _ in p.out], [g for _, g in p.out]


def line_blocks(text: str) -> tuple[list[int], list[str], list[str] | None]:
    """(line numbers, lines, no tags) of a text."""
    return *split_lines(text), None


def spreads(tables: list[tuple[DataFrame, str, str | None]], wanted: set[int] | None, blocks=line_blocks) -> DataFrame:
    """(k, n, one): pages with different bodies that hold a block, and whether all are of one host, over all rows of the (frame, text, host) tables; at k = 0 the number of different pages. ``wanted``: the blocks asked for, None for every block."""
    spark = tables[0][0].sparkSession
    shared = spark.sparkContext.broadcast(None if wanted is None else frozenset(wanted))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        got, want = {}, shared.value
        for t, h in zip(b["_t"], b["_h"]):
            _, lines, _ = blocks(utf8(t))
            if lines:
                body = _line_hash(max(lines, key=len))  # stands for the page's body: alike in reprints
                got[0, body] = h
                for x in lines:
                    for k in block_keys(x):
                        if want is None or k in want:
                            got[k, body] = h
        return pd.DataFrame([(*k, utf8(h)) for k, h in got.items()], columns=["k", "body", "host"])

    out = None
    for df, text, host in tables:
        src = df.select(F.col(text).alias("_t"), (F.col(host) if host else F.lit("")).alias("_h")).where("_t IS NOT NULL")
        one = src.mapInPandas(per_batch(run), "k long, body long, host string")
        out = one if out is None else out.unionByName(one)
    # rows per body first (an exact distinct count in two pre-aggregated steps)
    per = out.groupBy("k", "body").agg(F.min("host").alias("lo"), F.max("host").alias("hi"))
    return per.groupBy("k").agg(F.count("*").alias("n"), (F.min("lo") == F.max("hi")).alias("one"))


def spread_of(tables: list[tuple[DataFrame, str, str | None]], wanted: set[int], blocks=line_blocks) -> tuple[dict[int, tuple[int, bool]], int]:
    """({block: (pages with different bodies that hold it, whether all are of one host)}, number of different pages), over all rows of the (frame, text, host) tables.

    ``wanted`` comes from the bounded sample; what is shuffled are the hits on it.
    """
    n = {r["k"]: (r["n"], r["one"]) for r in spreads(tables, wanted, blocks).collect()}  # at most one row a wanted block
    return n, n.pop(0, (0, False))[0]


ONCE = 2  # a sentence that is body if no second page holds it


def recurrence_labels(lines: list[str], n: dict[int, tuple[int, bool]], pages: int) -> list[int]:
    """Labels of a training page's blocks: 1 furniture, 0 body, ``OPEN`` undecided."""
    y = []
    for x in lines:
        # sentences are reprinted across hosts, in edited texts too, so there they must recur more widely
        prose = _STOP.search(x) and len(x) > 25
        seen = [n.get(k, (0, False)) for k in block_keys(x)]
        wide, *parts = (c >= max(FEW, WIDE * pages) * (PROSE if prose and not one else 1) for c, one in seen)
        if wide or (parts and all(parts)):
            y.append(0 if FORMULA.search(x) else 1)
        elif prose and len(x) > 40 and seen[0][0] < 2:
            y.append(0)
        else:
            y.append(OPEN)
    return _closed(y)


def _closed(y: list[int]) -> list[int]:
    return y if 1 in y else [0 if v == OPEN else v for v in y]


def rule_labels(lines: list[str]) -> list[int] | None:
    """Labels of a page by strict rules; None where they leave doubt (the page is not used for training)."""
    y = [0] * len(lines)
    for t, x in enumerate(lines):
        parts = [p.strip().lower() for p in _SEP.split(x)] if _separated(x) else ()
        if SURE.match(x) or _TAIL.search(x[-40:]) or (len(parts) >= 2 and parts[0] in SECTIONS and sum(p in SECTIONS for p in parts) >= len(parts) - 1):
            y[t] = 1
    # section names one to a line: at least two in a row
    solo = [x.lower() in SECTIONS for x in lines]
    for t in range(len(lines)):
        if solo[t]:
            if (t and (solo[t - 1] or y[t - 1])) or (t + 1 < len(lines) and solo[t + 1]):
                y[t] = 1
            else:
                return None
    t = 0
    while t < len(lines):
        if STORIES.match(lines[t]):
            y[t] = 1
            b = bullet(lines[t + 1]) if t + 1 < len(lines) else ""
            k = t + 1
            while k < len(lines) and not y[k] and bullet(lines[k]) == b and not STORIES.match(lines[k]) and not re.search(r"[.。:：]$", lines[k]) and len(lines[k]) < 140:
                y[k] = 1
                k += 1
            if k - t > 6 or k == t + 1:
                return None
            t = k
        else:
            t += 1
    return y


def labels(lines: list[str], n: dict[int, tuple[int, bool]], pages: int) -> list[int]:
    """Recurrence and seeds together; what neither recurs nor is seeded is body where the seeds leave no doubt, else open."""
    return _seeded(recurrence_labels(lines, n, pages), rule_labels(lines))


def _seeded(y: list[int], seeds: list[int] | None) -> list[int]:
    if seeds is None:
        return y
    if 1 in seeds or 1 in y:
        return [1 if 1 in (a, b) else 0 for a, b in zip(y, seeds)]
    return y


def fit_chain(texts: list[str], n: dict[int, tuple[int, bool]] | None = None, pages: int = 0, epochs: int = 8, blocks=line_blocks) -> Chain:
    train = []
    for t in texts:
        _, lines, tags = blocks(t)
        if lines:
            f, e = page_feats(lines, tags)
            train.append((f, e, labels(lines, n or {}, pages)))
    return Chain(6).fit(train, epochs)


class Stripper:
    """Fitted models that mark a page's furniture lines; travels to the workers."""

    def __init__(self, chain: Chain, trees: BaggedTrees | None, blocks=line_blocks) -> None:
        self.chain, self.trees, self.blocks = chain, trees, blocks

    def marks(self, lines: list[str], tags: list[str] | None = None) -> list[int]:
        """1 for each furniture block of a page, by Viterbi."""
        if not lines:
            return []
        f, e = page_feats(lines, tags)
        return self.chain.decode(self.chain.emissions(f), e)

    def furniture(self, text: str, check_residue: bool = False) -> tuple[list[int], list[str], list[int]]:
        """(numbers, texts, labels) of a page's blocks."""
        no, lines, tags = self.blocks(text)
        y = self.marks(lines, tags)
        if any(y):
            if check_residue and residue.verdict(text, False) == 2:
                return no, lines, [0] * len(y)
            if self.trees is not None:
                body = "\n".join(x for x, v in zip(lines, y) if not v)
                if len(body) < 200 or sum(bool(_STOP.search(x)) for x, v in zip(lines, y) if not v) < 0.5 * (len(y) - sum(y)):
                    if self.trees.predict(np.asarray([spam.features(text)]))[0] > 0.5:
                        return no, lines, [0] * len(y)
        return no, lines, y

    def marks_of(self, f: list[bytes], n: list[bytes], e: list[bytes]) -> list[np.ndarray]:
        """:meth:`marks` of many pages at once, from their features (of :func:`read_pages`)."""
        size = np.array([len(x) for x in e])
        feats, n, e = np.frombuffer(b"".join(f), dtype=np.uint16), np.frombuffer(b"".join(n), dtype=np.uint32).astype(np.int64), np.frombuffer(b"".join(e), dtype=np.uint8)
        at, live = places(size)
        y = np.empty(len(e), dtype=np.uint8)
        y[at] = self.chain.paths(self.chain.scores(feats, n)[at], e[at], live)
        return np.split(y, np.cumsum(size)[:-1])

    def body(self, text: str) -> str:
        _, lines, tags = self.blocks(text)
        return "\n".join(x for x, v in zip(lines, self.marks(lines, tags)) if not v)


def fit(tables: list[tuple[DataFrame, str, str, str | None]], spam_pages: DataFrame | None = None, sample: int = SAMPLE, blocks=line_blocks) -> Stripper:
    """``blocks``: :func:`line_blocks` for texts, :func:`dom_blocks` for HTML. Models from at most ``sample`` pages of each table (frame, key, text, host) and at most ``sample`` pages for the spam trees; recurrence is counted over all pages."""
    texts = []
    for df, key, text, _ in tables:
        texts += [r[text] for r in sample_rows(df.where(F.length(F.trim(F.col(text))) > 0), key, sample)]
    wanted = {k for t in texts for x in blocks(t)[1] for k in block_keys(x)}
    n, pages = spread_of([(df, text, host) for df, _, text, host in tables], wanted, blocks) if wanted else ({}, 0)
    trees = None
    if spam_pages is not None:
        rows = sample_rows(spam_pages.where(F.length(F.trim("text")) > 0), "doc_id", sample)
        x = np.array([spam.features(r["text"]) for r in rows]).reshape(-1, len(spam.FEATURES))
        y = spam.weak_label(x) if len(x) else np.zeros(0)
        trees = BaggedTrees(x[y >= 0], y[y >= 0])
    return Stripper(fit_chain(texts, n, pages, blocks=blocks), trees, blocks)


READ = "h binary, cols int, text string, lo long, hi long, body long, f binary, n binary, e binary, seeds binary, keys array<long>, parts binary, flags binary, asked array<long>"
PROSE_FLAG, LONG_FLAG, FORMULA_FLAG = 1, 2, 4


def read_pages(tables: list[tuple[DataFrame, str, str, str | None]], blocks=line_blocks) -> DataFrame:
    """``READ`` of each different text with blocks (written): what the fit and the decoding of a page rest on, computed once. cols: a bit for each table that holds it; lo, hi: smallest and largest hash of its hosts; per block its features, number of ``block_keys`` and whether it is prose, long prose, a formula."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, cols, t, lo, hi in zip(b["h"], b["cols"], b["_t"], b["lo"], b["hi"]):
            _, lines, tags = blocks(utf8(t))
            if lines:
                f, n, e = flat_feats(lines, tags)
                seeds = rule_labels(lines)
                keys = [block_keys(x) for x in lines]
                prose = [bool(_STOP.search(x)) and len(x) > 25 for x in lines]
                flags = bytes(PROSE_FLAG * p + LONG_FLAG * (p and len(x) > 40) + FORMULA_FLAG * ("\t" in x or bool(FORMULA.match(x))) for p, x in zip(prose, lines))
                asked = [k[0] for k, v in zip(keys, flags) if v & LONG_FLAG]
                body = _line_hash(max(lines, key=len))  # stands for the page's body: alike in reprints
                out.append((h, cols, t, lo, hi, body, f.tobytes(), np.array(n, dtype=np.uint32).tobytes(), bytes(e), None if seeds is None else bytes(seeds), [k for g in keys for k in g], np.array([len(g) for g in keys], dtype=np.uint32).tobytes(), flags, asked))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in READ.split(", ")])

    src = None
    for k, (df, _, text, host) in enumerate(tables):
        one = df.select(F.col(text).alias("_t"), F.lit(1 << k).alias("cols"), F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("")) if host else F.lit("")).alias("host")).where("_t IS NOT NULL")
        src = one if src is None else src.unionByName(one)
    different = src.groupBy(F.unhex(F.md5("_t")).alias("h")).agg(F.bit_or("cols").alias("cols"), F.first("_t").alias("_t"), F.min("host").alias("lo"), F.max("host").alias("hi"))
    return cut(different.mapInPandas(per_batch(run), READ), "read")


def fit_whole(tables: list[tuple[DataFrame, str, str, str | None]], blocks=line_blocks, read: DataFrame | None = None) -> Stripper:
    """As :func:`fit`, without spam trees, from every page of the tables; copies of a text count once. ``read``: :func:`read_pages` of the tables, where it is there already.

    The driver sees the blocks that recur widely (at most the blocks of a page / ``WIDE``)
    and one vector a task and step.
    """
    pages_read = read_pages(tables, blocks) if read is None else read
    # rows per body first (an exact distinct count in two pre-aggregated steps)
    held = pages_read.select(F.explode(F.array_append(F.array_distinct("keys"), F.lit(0).cast("long"))).alias("k"), "body", "lo", "hi")
    per = held.groupBy("k", "body").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("k").agg(F.count("*").alias("n"), (F.min("lo") == F.max("hi")).alias("one"))
    n = cut(per.where("n > 1 OR k = 0"), "spreads")
    found = n.where("k = 0").first()
    pages = found["n"] if found else 0
    wide = (F.col("n") >= max(FEW, WIDE * pages)) & (F.col("k") != 0)
    got = n.where(wide).orderBy("k").toPandas()
    shared = n.sparkSession.sparkContext.broadcast((got["k"].to_numpy(dtype=np.int64), got["n"].to_numpy() >= max(FEW, WIDE * pages) * PROSE, got["one"].to_numpy(dtype=bool)))
    again = pages_read.select("h", F.explode("asked").alias("k")).join(n.where(~wide & (F.col("k") != 0)).select("k"), "k").groupBy("h").agg(F.collect_set("k").alias("again"))

    def settle(b: pd.DataFrame) -> pd.DataFrame:
        """:func:`recurrence_labels` of the blocks of many pages at once, the ``ONCE`` ones settled, and :func:`_seeded`."""
        known, widely, alone = shared.value
        keys = np.concatenate(b["keys"].to_numpy())
        parts, flags = np.frombuffer(b"".join(b["parts"]), dtype=np.uint32).astype(np.int64), np.frombuffer(b"".join(b["flags"]), dtype=np.uint8)
        first = np.cumsum(parts) - parts
        prose = flags & PROSE_FLAG > 0
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), dtype=bool)
        recurs = hit.copy()
        recurs[hit] &= ~np.repeat(prose, parts)[hit] | alone[at[hit]] | widely[at[hit]]
        rest = np.add.reduceat(recurs, first, dtype=np.int64) - recurs[first]
        label = np.where(recurs[first] | (parts > 1) & (rest == parts - 1), np.where(flags & FORMULA_FLAG, 0, 1), np.where((flags & LONG_FLAG > 0) & ~hit[first], ONCE, OPEN)).astype(np.int8)
        out, at = [], 0
        key = keys[first]
        for size, seeds, again in zip(map(len, b["flags"]), b["seeds"], b["again"]):
            y = label[at : at + size]
            if again is not None:
                y = np.where((y == ONCE) & np.isin(key[at : at + size], again), OPEN, y)
            y = np.where(y == ONCE, 0, y).tolist()
            out.append(np.array(_seeded(_closed(y), None if seeds is None else list(seeds)), dtype=np.int8).tobytes())
            at += size
        return b[["f", "n", "e"]].assign(y=out)

    train = cut(pages_read.select("h", "f", "n", "e", "seeds", "keys", "parts", "flags").join(again, "h", "left").mapInPandas(per_batch(settle), PAGES), "train")
    drop(n)
    if read is None:
        drop(pages_read)
    chain = fit_chain_whole(train, 6)
    drop(train)
    return Stripper(chain, None, blocks)


def furniture_lines(df: DataFrame, key: str, text: str, table_name: str, model: Stripper, check_residue: bool) -> DataFrame:
    """(table_name, rec_id, line_no) of every furniture line; one pass, no shuffle but for repeated rows."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        ids, nos = [], []
        for i, t in zip(b["_k"], b["_t"]):
            no, _, y = model.furniture(utf8(t), check_residue)
            for k, v in zip(no, y):
                if v:
                    ids.append(i)
                    nos.append(k)
        return pd.DataFrame({"rec_id": ids, "line_no": nos})

    src = df.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t")).where("_k IS NOT NULL AND _t IS NOT NULL")
    return src.mapInPandas(per_batch(run), "rec_id string, line_no int").select(F.lit(table_name).alias("table_name"), "rec_id", "line_no")
