"""Text cut off by field limits or mid-transfer.

A backward character n-gram model compares, for the final context of a value,
how likely such a context is at the end of a line or text against inside one.
Contexts of up to 16 characters are read from the end backwards; each further
character's probability at an end is drawn towards its probability inside a
line, so that unseen contexts say nothing. Counts are kept apart by language,
column and the kind of line. An end is a place before a stop or a line break, so
that a complete text whose last stop is missing is still told from a cut. Log-odds
meet a prior of each language, column, kind of line and kind of page: how often
complete lines of that kind (those before a page's last) lack a stop, and the
share of cut texts, which is the one under which the last lines are likeliest.
Values are judged by their body (p3); one whose last line is furniture went on
to its end.

Contexts are counted over all values, copies of a text once: the last lines in
question come first, and of all others only contexts that such a line asks for
are counted. A last line of a few words gives its n-grams too little to tell a name from a cut,
so it is judged by counts over all values: how many different lines before the
last ones begin with it and go on, against how many texts end with it or hold it
as a line of its own. Ratios, and one count for all copies of a text, keep the
result free of the input's size and of reprints. A line of tags is judged by its last tag.

Defined cases: null and blank values are not cut; residue (p6) and spam (p10)
are not cut; a value that ends with a stop is complete; a value that ends with
a replacement character or a note of left-out characters is cut; an ellipsis is
meant where the whole short last line recurs in a share ``RECUR`` of the
different texts (two at least) and begins no longer lines, else a cut.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import residue, spam
from gleaner.llm.boilerplate import Stripper, bullet
from gleaner.llm.common import key128, per_batch, utf8
from gleaner.llm.trees import BaggedTrees
from gleaner.llm.trees import fit_whole as fit_trees
from gleaner.session import cut

ORDERS = (1, 2, 3, 4, 6, 8, 11, 16)
RECUR = 3e-4
FEW = 45
MID, WORD = 2, 6  # lines that go on, to ends, for a cut inside a word and after one
BITS = 24
MAP_BITS = 27
PULL = 1.5
LEAN = 4.0
MEANT = 40
LEAST = 0.4  # log-odds of a complete end under which a value counts as cut: half the expected F1
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, j, 1 << 64) for j in range(ORDERS[-1])], dtype=np.uint64)
_CUT = re.compile(r"(?:\[\s*(?:…|\.\.\.)\s*\]|\[\+\d+ (?:chars?|more)\]|�|\((?:more|truncated)\)|<truncated>|(?<=\S)-)\s*$")
_CUT_LAST = "]�)>-"  # the last characters of what _CUT finds
_DOTS = re.compile(r"(?:…|\.\.\.|。。。)\s*$")
_DONE = re.compile(r"[.!?。！？][\"'”’»)\]）」』]*$")
_DIGIT = re.compile(r"\d")
_STOP = re.compile(r"[.!?](?=\s)|[。！？]")
_ZH = re.compile("[一-鿿]")
LANGS = ("en", "zh", "de", "es")


def _done(s: str) -> bool:
    """Whether ``_DONE`` is found in a stripped text."""
    c = s[-1:]
    return bool(c) and (c in ".!?。！？" or c in "\"'”’»)]）」』" and bool(_DONE.search(s)))


def language(s: str) -> int:
    """Index into LANGS from the characters and commonest words of a text."""
    if not s.isascii() and len(_ZH.findall(s)) * 4 > len(s):
        return 1
    t = f" {s.lower()} "
    n = [t.count(" the ") + t.count(" of ") + t.count(" a ") * 0.5, 0, sum(t.count(w) for w in (" der ", " die ", " das ", " und ", " ein ", " eine ", " den ")), sum(t.count(w) for w in (" el ", " la ", " los ", " del ", " un ", " una ", " que "))]
    return int(np.argmax(n))


PAGES = 4


def _kinds(lines: list[str], last: str = "") -> int:
    """How the page's longer plain lines end: 0 there are none (nor a stop inside the last one); 1 all with a stop; 2 mostly without; 3 a few without."""
    plain = [x for x in lines if len(x) > 25 and (len(x) > 60 or not x.isascii() and _ZH.search(x)) and not bullet(x)]
    if not plain:
        return int(bool(_STOP.search(last)))
    bare = sum(not _done(x) for x in plain)
    return 1 if not bare else 2 if bare * 2 > len(plain) else 3


KINDS = 8


def _line_kind(line: str, page: int) -> int:
    """Kind of a whole or partial line (tag line, bullet, prose with a stop inside, long, short, a few words), with the page's kind."""
    b = bullet(line)
    if b == "r" or line.startswith("http"):
        k = 7
    elif line[0] in "#@" and not b:
        k = 5
    elif len(line) <= 12 if _ZH.search(line) else line.count(" ") < (4 if b else 3) and len(line) <= 45:
        k = 6 if b else 4
    elif sum(map(str.isalpha, line)) < 8 and not _ZH.search(line):
        k = 4
    else:
        k = 0 if b else 1 if _STOP.search(line) else 2 if len(line) > (45 if _ZH.search(line) else 90) else 3
    return k * PAGES + page


def _listed(before: str, line: str) -> bool:
    """Whether a line goes on with lines of its form that have no stop."""
    a, b = bullet(before) if before else "", bullet(line)
    return bool(before) and not _done(before) and (a == b or bool(a and b))


def _codes(lines: list[str]) -> np.ndarray:
    """Characters of all lines in one array, a line break before each, digits alike."""
    s = _DIGIT.sub("0", "\n" + "\n".join(lines)) if lines else ""
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)


def _seal(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ (salt * np.uint64(_BASE))) * np.uint64(0xBF58476D1CE4E5B9)


def _partial_kinds(line: str, page: int) -> np.ndarray:
    """Line kind as it would be if the line were cut after each of its characters (index 0: before the first)."""
    n = len(line)
    zh = bool(_ZH.search(line))
    b = bullet(line)
    out = np.full(n + 1, 0 if b else 3, dtype=np.uint64)
    if b == "r" or line.startswith("http"):
        return np.full(n + 1, 7 * PAGES + page, dtype=np.uint64)
    if line[0] in "#@" and not b:
        out[:] = 5
    else:
        if not b:
            out[(45 if zh else 90) + 1 :] = 2
            if (m := _STOP.search(line)) and m.end() + 1 <= n:
                out[m.end() + 1 :] = 1
        if zh:
            few = 13
        else:
            few, spaces = min(n, 45) + 1, 0
            for k, c in enumerate(line[:46]):
                spaces += c == " "
                if spaces >= (4 if b else 3):
                    few = k + 1
                    break
        out[:few] = 6 if b else 4
    return out * np.uint64(PAGES) + np.uint64(page)


def _ends(line: str) -> np.ndarray:
    """Whether a sentence or the line ends after each of the line's characters (index 0: before the first)."""
    out = np.zeros(len(line) + 1, dtype=bool)
    out[-1] = True
    for m in _STOP.finditer(line):
        out[m.start()] = out[m.end()] = True
    if m := _DONE.search(line):
        out[m.start()] = True
    out[0] = False
    return out


def body_lines(text: str, stripper: Stripper | None, y: np.ndarray | None = None) -> tuple[list[str], bool]:
    """A text's lines without furniture, and whether its last line is furniture (then the text went on to its end). ``y``: which lines are furniture, where it is known."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    if stripper is None or not lines:
        return lines, False
    if y is None:
        y = stripper.marks(lines)
    return [x for x, v in zip(lines, y) if not v], bool(y[-1])


def _keys(salt: int, line: str) -> np.ndarray:
    """Keys of the contexts at the end of a line, one for each of ``ORDERS`` up to its length and the break before it."""
    codes = _codes([line[-ORDERS[-1] :]])[::-1]
    if len(line) >= ORDERS[-1]:
        codes = codes[:-1]
    with np.errstate(over="ignore"):
        h = np.cumsum(codes * _POWERS[: len(codes)], dtype=np.uint64)
    whole = [o for o in ORDERS if o <= len(codes)]
    return _seal(h[np.array(whole) - 1], np.uint64(salt)).view(np.int64)


BODY = "col int, h binary, lines string, stratum int, page int, open boolean, verdict int, prior boolean, salt int, listed boolean, last string, before string, keys array<long>, size long, spam binary"


def _body(col: int, h: bytes, text: str, stripper: Stripper | None, graded: bool, spam_too: bool, marks: np.ndarray | None = None) -> tuple | None:
    """``BODY`` of a value: verdict 0 no case, 1 cut, 2 a short last line with an ellipsis, 3 one of a few words or tags (2 and 3 are left to :func:`cut_lines`), 4 left to the log-odds; prior: an unstopped last line that the share of cut texts rests on."""
    parts, ended = body_lines(text, stripper, marks)
    s = text.strip()
    if not s:
        return None
    known = []

    def is_residue() -> int:
        if not known:
            known.append(residue.verdict(s, False))
        return known[0]

    signed = s[-1] in _CUT_LAST and bool(_CUT.search(s))
    verdict, last, before = 0, parts[-1] if parts else "", parts[-2] if len(parts) > 1 else ""
    page = _kinds(parts[:-1], last)
    dots = _DOTS.search(last)
    if _done(s) and not _DOTS.search(s) and not re.search(r"\d\.$", s):
        pass
    elif signed:
        verdict, last, before = 1, s.split("\n")[-1], ""
    elif parts and not ended:
        if dots:
            verdict = 2 if len(last) <= MEANT and not _STOP.search(last[: dots.start()]) else 1
        else:
            verdict = 3 if _line_kind(last, page) // PAGES in (4, 5, 6) else 4
    if verdict and not signed and is_residue() == 2:
        verdict = 0
    # what is counted of it
    stratum, open_, prior, salt, listed, keys = (col * 4 + language(text)) * PAGES * KINDS, False, False, 0, False, None
    lines = None
    if parts:
        end = parts[-1]
        if sign := _DOTS.search(end) or _CUT.search(end):
            end = end[: sign.start()].rstrip()
        open_ = not ended and (bool(sign) or not _done(end))
        lines = "\n".join(parts[:-1] + [end])
        prior = bool(end) and open_ and not sign and not is_residue()
        if prior or verdict == 4:
            salt, listed = stratum + _line_kind(end, page), _listed(parts[-2] if len(parts) > 1 else "", end)
            keys = _keys(salt, end).tolist()
    size = sum(map(len, "".join(parts).split())) if graded and parts and is_residue() != 2 else 0
    told = np.asarray(spam.features(s), dtype=float).tobytes() if spam_too else None
    return col, h, lines, stratum, page, open_, verdict, prior, salt, listed, last, before, keys, size, told


def bodies(columns: list[tuple[DataFrame, str]], stripper: Stripper | None, spam_column: int | None = None, graded: bool = False, read: DataFrame | None = None) -> DataFrame:
    """``BODY`` of each different value of the (frame, text) columns (written); size (characters of the body but white space, 0 for residue) is given where ``graded``. ``read``: :func:`boilerplate.read_pages` of the columns, whose features are decoded then."""
    out, shared = None, columns[0][0].sparkSession.sparkContext.broadcast(stripper)
    names, every = [c.split(" ")[0] for c in BODY.split(", ")], range(len(columns))
    if read is not None:

        def decode(b: pd.DataFrame) -> pd.DataFrame:
            marks = shared.value.marks_of(b["f"], b["n"], b["e"])
            got = [_body(col, h, t, shared.value, graded, col == spam_column, y) for h, cols, t, y in zip(b["h"], b["cols"], b["text"], marks) for col in every if cols >> col & 1]
            return pd.DataFrame(got, columns=names)

        return cut(read.select("h", "cols", "text", "f", "n", "e").mapInPandas(per_batch(decode), BODY), "bodies")
    for col, (df, text) in enumerate(columns):

        def run(b: pd.DataFrame, col: int = col) -> pd.DataFrame:
            got = [_body(col, h, t, shared.value, graded, col == spam_column) for h, t in zip(b["h"], b["_t"])]
            return pd.DataFrame([x for x in got if x], columns=names)

        one = df.where(F.col(text).isNotNull()).select(digest(text).alias("h"), F.col(text).alias("_t")).dropDuplicates(["h"]).mapInPandas(per_batch(run), BODY)
        out = one if out is None else out.unionByName(one)
    return cut(out, "bodies")


def digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def _table() -> np.ndarray:
    """Bits of the characters below U+10000: 1 a stop before white space, 2 a stop anywhere, 4 white space, 8 may follow a stop at a line's end, 16 Chinese, 32 a letter, 64 a digit."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    chars = [chr(c) for c in range(1 << 16)]
    for bit, of in ((1, ".!?".__contains__), (2, "。！？".__contains__), (4, re.compile(r"\s").match), (8, "\"'”’»)]）」』".__contains__), (16, _ZH.match), (32, str.isalpha), (64, _DIGIT.match)):
        out[[bool(of(c)) for c in chars]] |= bit
    return out


_BITS = _table()


class _Shapes:
    """What :func:`_partial_kinds`, :func:`_ends`, :func:`_line_kind` and ``_DONE`` tell of many lines, by arrays over all of their characters (a line break before each line)."""

    def __init__(self, lines: list[str], page: np.ndarray) -> None:
        text = "\n" + "\n".join(lines)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        far = np.flatnonzero(c >= 1 << 16)
        bits = _BITS[np.minimum(c, (1 << 16) - 1)] if len(far) else _BITS[c]
        if len(far):
            bits[far] = 0
            c = np.frombuffer(_DIGIT.sub("0", text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.codes = np.where(bits & 64, np.uint32(48), c).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
        self.n = n = np.array([len(x) for x in lines], dtype=np.int64)
        self.first = first = np.cumsum(n + 1) - n - 1
        last = first + n
        self.bullets = [bullet(x) for x in lines]
        b = np.array([bool(x) for x in self.bullets])
        address = np.array([g == "r" or x.startswith("http") for g, x in zip(self.bullets, lines)])
        tag = np.isin(c[first + 1], (35, 64)) & ~b & ~address
        # stops; one at the very end of a line stands before a line break
        then = np.append(bits[1:] & 4, 4)
        stops = np.flatnonzero((bits & 1 > 0) & (then > 0) | (bits & 2 > 0))
        end = np.zeros(len(c), dtype=bool)
        end[stops - 1] = end[stops] = end[last] = True
        q = last.copy()
        while len(go := np.flatnonzero(bits[q] & 8)):
            q[go] -= 1
        self.done = bits[q] & 3 > 0
        end[q[self.done] - 1] = True
        end[first] = False
        self.end = end

        def of_line(at: np.ndarray, k: np.ndarray | int = 0) -> np.ndarray:
            """Place in its line of the k-th of the places ``at`` in each line, far off where there is none."""
            i = np.searchsorted(at, first) + k
            got = np.append(at, len(c) + (1 << 40))[np.minimum(i, len(at))]
            return np.where(got <= last, got - first, 1 << 40)

        chinese = of_line(np.flatnonzero(bits & 16)) <= n
        spaces = np.flatnonzero(c == 32)
        # the kind a line would have if it were cut after each of its characters
        third = of_line(spaces, np.where(b, 3, 2))
        few = np.minimum(np.where(chinese, 13, np.where(third <= 46, third, np.minimum(n, 45) + 1)), n + 1)
        stop = of_line(stops)
        told = np.where(b, n + 1, np.maximum(few, np.minimum(stop + 1, n + 1)))
        long = np.where(b, n + 1, np.maximum(few, np.minimum(np.minimum(np.where(chinese, 45, 90) + 1, n + 1), told)))
        whole = address | tag
        few, long, told = (np.where(whole, n + 1, x) for x in (few, long, told))
        kinds = np.column_stack([np.where(address, 7, np.where(tag, 5, np.where(b, 6, 4))), np.where(b, 0, 3), np.full(len(n), 2), np.full(len(n), 1)])
        self.runs = np.column_stack([few, long - few, told - long, n + 1 - told]).ravel()
        self.partial = kinds * PAGES + page[:, None]
        # and the kind it has
        within = np.add.reduceat((bits & 32) > 0, first, dtype=np.int64)
        short = np.where(chinese, n <= 12, (third > n) & (n <= 45))
        inside = (stop < n) | (stop == n) & (bits[last] & 2 > 0)
        k = np.where(short, np.where(b, 6, 4), np.where((within < 8) & ~chinese, 4, np.where(b, 0, np.where(inside, 1, np.where(n > np.where(chinese, 45, 90), 2, 3)))))
        self.kind = np.where(address, 7, np.where(tag, 5, k)) * PAGES + page
        for i in np.unique(np.searchsorted(first, far, side="right") - 1).tolist():
            self.kind[i] = _line_kind(lines[i], int(page[i]))


def _count(shapes: _Shapes, stratum: np.ndarray, open_: np.ndarray, bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys at ends, keys inside lines; number of places at ends, and inside, of each line kind) of lines, their stratum and whether their end is open; only keys that stand in the bit map. A context is looked at only where the shorter one before it is asked for, as it is for each last line in question."""
    codes, n, at_end = shapes.codes, shapes.n + 1, shapes.end
    place = (np.arange(len(codes), dtype=np.int32) - np.repeat(shapes.first, n)).astype(np.int32)
    kinds = shapes.partial + stratum[:, None]
    kind = np.repeat(kinds.ravel().astype(np.int32), shapes.runs)
    known = np.ones(len(codes), dtype=bool)
    known[(shapes.first + shapes.n)[open_]] = False
    ended, going = np.bincount(kind[known & at_end]), np.bincount(kind[known & ~at_end])
    at = np.flatnonzero(known)
    ends, inside = [], []
    with np.errstate(over="ignore"):
        salt = np.repeat(kinds.ravel().astype(np.uint64) * np.uint64(_BASE), shapes.runs)
        h, done = np.zeros(len(at), dtype=np.uint64), 0
        for order in ORDERS:
            if order > 1:
                ok = place[at] >= order - 1
                at, h = at[ok], h[ok]
            for j in range(done, order):
                h += codes[at - j] * _POWERS[j]
            done = order
            key = (h ^ salt[at]) * np.uint64(0xBF58476D1CE4E5B9)
            slot = key >> np.uint64(64 - width)
            ok = bits[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32) & np.uint32(1) == 1
            at, h, key = at[ok], h[ok], key[ok]
            e = at_end[at]
            ends.append(key[e])
            inside.append(key[~e])
    return np.concatenate(ends), np.concatenate(inside), ended, going


def _odds(seen: np.ndarray, orders: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """log P(context | end) - log P(context | inside): seen (rows, ORDERS, 2) counts at ends and inside, orders in use, counts (rows, 2) of the line kind."""
    odds, alive = np.zeros(len(seen)), np.ones(len(seen), dtype=bool)
    e_before, c_before = totals[:, 0], totals[:, 1]
    for k in range(len(ORDERS)):
        alive &= orders > k
        e, c = seen[:, k, 0], seen[:, k, 1]
        inside = (c + 0.5) / (c_before + 1.0)
        odds += np.where(alive, np.log((e + PULL * inside) / (e_before + PULL) / inside), 0.0)
        e_before, c_before = e, c
        alive &= e + c > 0
    return odds


class Backward:
    """Contexts at ends and inside lines, over all values of its columns, and how often unstopped last lines of each kind are cuts.

    Last lines without a stop count as neither: whether they end is the question, and copies of one cut text must not answer it.
    """

    def __init__(self, columns: list[tuple[DataFrame, str]], rows: DataFrame) -> None:
        self.columns, self.rows = columns, rows

    def counts(self, asks: DataFrame) -> tuple[DataFrame, dict[int, tuple[float, float]], list, int]:
        """(k, e, c) of the ``keys`` of the written rows ``asks``; counts of each line kind; (kind and listed, unstopped, all) of lines before the last; number of texts."""
        n = asks.agg(F.sum(F.size("keys"))).first()[0] or 0
        width = min(max(int(n * 32).bit_length(), 16), MAP_BITS)
        slot = F.shiftrightunsigned("k", 64 - width)
        words = asks.select(F.explode("keys").alias("k")).select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("v")).toArrow()
        bits = np.zeros(1 << width - 5, dtype=np.uint32)
        bits[words["w"].to_numpy()] = words["v"].to_numpy()
        shared = asks.sparkSession.sparkContext.broadcast(bits)

        def run(b: pd.DataFrame) -> pd.DataFrame:
            size = np.cumsum(b["lines"].str.len()) // (1 << 21)  # about two million characters at a time
            for _, g in b.groupby(size.to_numpy()):
                lines, of, last = [], [], []
                for k, text in enumerate(g["lines"]):
                    got = text.split("\n")
                    head = len(got) - 1
                    if not got[-1]:
                        got.pop()
                    lines += got
                    of += [k] * len(got)
                    last += [False] * head + [True] * (len(got) - head)
                frames = [pd.DataFrame({"t": [3], "k": [0], "e": [0.0], "c": [float(len(g))]})]
                if lines:
                    of, last = np.array(of), np.array(last)
                    stratum = g["stratum"].to_numpy()[of].astype(np.int64)
                    shapes = _Shapes(lines, g["page"].to_numpy()[of].astype(np.int64))
                    # lines before the last: whether they go on with a list, whether they lack a stop
                    marks = shapes.bullets
                    goes = np.array([a == b or bool(a and b) for a, b in zip([""] + marks, marks)])
                    goes[1:] &= (of[1:] == of[:-1]) & ~shapes.done[:-1]
                    goes[0] = False
                    kind = ((stratum + shapes.kind) * 2 + goes)[~last]
                    every = np.bincount(kind)
                    bare = np.bincount(kind, weights=~shapes.done[~last], minlength=len(every))
                    some = np.flatnonzero(every)
                    frames.append(pd.DataFrame({"t": 2, "k": some, "e": bare[some], "c": every[some].astype(float)}))
                    ends, inside, *places = _count(shapes, stratum, last & g["open"].to_numpy(dtype=bool)[of], shared.value, width)
                    for w, keys, n in zip("ec", (ends, inside), places):
                        u, c = np.unique(keys, return_counts=True)
                        frames.append(pd.DataFrame({"t": 0, "k": u.view(np.int64), "e": 0.0, "c": 0.0} | {w: c.astype(float)}))
                        some = np.flatnonzero(n)
                        frames.append(pd.DataFrame({"t": 1, "k": some, "e": 0.0, "c": 0.0} | {w: n[some].astype(float)}))
                yield pd.concat(frames)

        def batches(it):
            for b in it:
                if len(b):
                    yield from run(b)

        got = self.rows.where("lines IS NOT NULL").select("lines", "stratum", "page", "open").mapInPandas(batches, "t int, k long, e double, c double")
        got = cut(got.groupBy("t", "k").agg(F.sum("e").alias("e"), F.sum("c").alias("c")), "contexts")
        few = got.where("t > 0").collect()  # line kinds
        return (
            got.where("t = 0").select("k", "e", F.when(F.col("c") >= 2, F.col("c")).otherwise(0.0).alias("c")),
            {r["k"]: (r["e"] + 1.0, r["c"] + 1.0) for r in few if r["t"] == 1},
            [(r["k"], r["e"], r["c"]) for r in few if r["t"] == 2],
            int(sum(r["c"] for r in few if r["t"] == 3)),
        )

    def judged(self, rows: DataFrame) -> DataFrame:
        """``rows`` (of :func:`bodies`, written) that are suspicious, each with its verdict (1 to 3)."""
        names = ["col", "h", "salt", "listed", "prior", "verdict", "keys"]
        asks = rows.where("keys IS NOT NULL").select(names)
        if rows is not self.rows:
            asks = asks.withColumn("prior", F.lit(False)).unionByName(self.rows.where("prior").select(names).withColumn("verdict", F.lit(0)))
        seen, totals, whole, texts = self.counts(asks)
        per = asks.select(*names[:-1], F.size("keys").alias("orders"), F.posexplode("keys").alias("at", "k")).join(seen, "k", "left")
        per = per.groupBy(*names[:-1], "orders").agg(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("at", "e", "c"))).alias("seen"))

        def odds(b: pd.DataFrame) -> pd.DataFrame:
            x = np.zeros((len(b), len(ORDERS), 2))
            for k, got in enumerate(b["seen"]):
                for r in got:
                    x[k, r["at"]] = r["e"], r["c"]
            total = np.array([totals.get(k, (1.0, 1.0)) for k in b["salt"]])
            return b[names[:-1]].assign(odds=_odds(x, b["orders"].to_numpy(), total))

        kind = "col int, h binary, salt int, listed boolean, prior boolean, verdict int, odds double"
        told = cut(per.mapInPandas(per_batch(odds), kind), "odds")
        hist = told.where("prior").groupBy("salt", "listed", F.round("odds", 3).alias("odds")).count().collect()  # a bounded range in steps
        self._priors(whole, [(r["salt"], r["listed"], r["odds"], r["count"]) for r in hist], texts)
        base, bare, every = self.base, self.bare, self.every

        def ended(b: pd.DataFrame) -> pd.DataFrame:
            prior = np.array([base + math.log(_bare(bare, every, k, g) + 1e-4) for k, g in zip(b["salt"], b["listed"])])
            return b.loc[b["odds"].to_numpy() + prior < LEAST, ["col", "h"]]

        is_cut = told.where("verdict = 4").select("col", "h", "salt", "listed", "odds").mapInPandas(per_batch(ended), "col int, h binary")
        # a sign of a cut outweighs the trees
        found = rows.where("verdict > 0").select("col", "h", "verdict", "last", "before", F.expr("IF(verdict > 2, spam, NULL)").alias("spam"))
        return found.where("verdict < 4").unionByName(found.where("verdict = 4").join(is_cut, ["col", "h"], "left_semi").withColumn("verdict", F.lit(1)))

    def _priors(self, whole: list[tuple[int, float, float]], asked: list[tuple[int, bool, float, int]], texts: int) -> None:
        """Log-odds of complete to cut among unstopped last lines, per stratum, kind of line and whether it goes on with a list.

        whole: (stratum, kind and listed; unstopped; all) of lines before the last, which are
        complete: a complete last line lacks its stop as often as they do. The share of
        cut texts is the one under which the last lines' log-odds are likeliest
        (expectation maximisation).
        """
        count: dict[int, list[float]] = {}
        for key, bare, n in whole:
            for k in (key, -1 - key % (PAGES * KINDS * 2)):  # of the stratum, and over all languages and columns
                got = count.setdefault(k, [0.0, 0.0])
                got[0] += bare
                got[1] += n
        every = sum(n[0] for k, n in count.items() if k < 0) / max(1.0, sum(n[1] for k, n in count.items() if k < 0)) or 0.5
        pooled = {k: (n[0] + LEAN * every) / (n[1] + LEAN) for k, n in count.items() if k < 0}
        self.bare = {k: (n[0] + LEAN * pooled[-1 - k % (PAGES * KINDS * 2)]) / (n[1] + LEAN) for k, n in count.items() if k >= 0} | pooled
        self.every = every
        odds = np.clip(np.array([o for *_, o, _ in asked], dtype=float), -8, 8)
        u = np.log(np.array([_bare(self.bare, every, k, g) for k, g, *_ in asked]) + 1e-4)
        times = np.array([n for *_, n in asked], dtype=float)
        share = 0.1
        for _ in range(60):
            # unstopped texts only: share of all texts, whose rest is complete
            p = share / (share + (1 - share) * np.exp(odds + u))
            share = (float((times * p).sum()) + 1.0) / (texts + 10.0)
        self.base = math.log((1 - share) / share)


def _bare(bare: dict[int, float], every: float, salt: int, listed: bool) -> float:
    key = int(salt) * 2 + bool(listed)
    return bare.get(key, bare.get(-1 - key % (PAGES * KINDS * 2), every))


def fit(columns: list[tuple[DataFrame, str, str]], stripper: Stripper | None = None, spam_column: int | None = None, graded: bool = False, read: DataFrame | None = None) -> tuple[Backward, BaggedTrees | None]:
    """Model over all values of the (frame, key, text) columns, and spam trees over all of ``spam_column``. ``read``: as in :func:`bodies`."""
    values = [(df, text) for df, _, text in columns]
    rows = bodies(values, stripper, spam_column, graded, read)
    return Backward(values, rows), None if spam_column is None else spam_trees(rows)


def spam_trees(rows: DataFrame) -> BaggedTrees:
    """Trees over all ``rows`` (of :func:`bodies`) with features that have a weak label."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(b["spam"]), dtype=float).reshape(-1, len(spam.FEATURES))
        y = spam.weak_label(x)
        known = np.flatnonzero(y >= 0)
        return pd.DataFrame({"k": b["k"].to_numpy()[known], "x": list(x[known]), "y": y[known]})

    labelled = rows.where("spam IS NOT NULL").select(F.xxhash64("h").alias("k"), "spam").mapInPandas(per_batch(run), "k long, x array<double>, y int")
    return fit_trees(cut(labelled, "labelled"))


def suspects(rows: DataFrame, model: Backward, trees: BaggedTrees | None = None) -> DataFrame:
    """(col, h, verdict, ``ASKED``) of the suspicious of ``rows`` (of :func:`bodies`) that ``trees`` don't take for spam."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        if trees is not None:
            told = b["spam"].notna().to_numpy()
            if told.any():
                x = np.frombuffer(b"".join(b["spam"][told]), dtype=float).reshape(-1, len(spam.FEATURES))
                keep = np.ones(len(b), dtype=bool)
                keep[told] = trees.predict(x) <= 0.5
                b = b[keep]
        return pd.DataFrame([(c, h, v, *asked(v, last, before)) for c, h, v, last, before in zip(b["col"], b["h"], b["verdict"], b["last"], b["before"])], columns=["col", "h", "verdict", "line", "whole", "bit", "whole_bit", "class"])

    return model.judged(rows).mapInPandas(per_batch(run), f"col int, h binary, verdict int, {ASKED}")


def _plain(line: str) -> str:
    """A line as it is counted: digits alike, one sign for an ellipsis at its end."""
    return _DIGIT.sub("0", _DOTS.sub("…", line) if line[-1:] in "….。" else line)


def _tags(line: str) -> list[str]:
    """The words of a line of tags, as they are counted; none of another line."""
    words = _plain(line).split() if line[0] in "#@" else []
    return words if words and words[-1][0] in "#@" and len(words[-1]) > 1 else []


def _slot(s: str) -> int:
    """Place of a line in the bit map of lines asked for."""
    h = sum((ord(c) + 1) * pow(_BASE, j, 1 << 64) for j, c in enumerate(s))
    return ((h * 0xBF58476D1CE4E5B9) & _MASK) >> (64 - BITS)


_FEW_POWERS = np.array([pow(_BASE, j, 1 << 64) for j in range(FEW + 1)], dtype=np.uint64)


def _starts(lines: list[str], bits: np.ndarray) -> tuple[list[int], list[int]]:
    """(line, k) wherever the first k of a line's first FEW + 1 characters stand in the bit map."""
    n = np.array([min(len(x), FEW + 1) for x in lines], dtype=np.int64)
    c = np.frombuffer("".join(x[: FEW + 1] for x in lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    first = np.cumsum(n) - n
    place = np.arange(len(c)) - np.repeat(first, n)
    with np.errstate(over="ignore"):
        h = np.cumsum(c * _FEW_POWERS[place], dtype=np.uint64)
        h -= np.repeat(np.where(first > 0, h[first - 1], np.uint64(0)), n)
        slot = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    at = np.flatnonzero(bits[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32) & np.uint32(1))
    return (np.searchsorted(first, at, side="right") - 1).tolist(), (place[at] + 1).tolist()


ASKED = "line binary, whole binary, bit long, whole_bit long, class binary"


def asked(verdict: int, last: str, before: str) -> tuple:
    """The columns ``ASKED`` of a value: keys of its last line without and with an ellipsis, and of the class of its copies (its last two lines)."""
    if verdict < 2:
        return None, None, None, None, None
    full = (_tags(last) or [_plain(last)])[-1] if verdict == 3 else _plain(last)
    stub = full[:-1].rstrip() if verdict == 2 else full
    return key128(stub), key128(full), _slot(stub), _slot(full), key128(f"{before}\n{last}")


def _goes_on(line: str, k: int) -> int:
    """2: the line goes on inside a word after its first k characters, 1: with another word, 0: with a sign or not at all."""
    c = line[k]
    if c.isalpha():
        return 2 if line[k - 1].isalpha() and not _ZH.match(c) else 1
    return int(c.isspace() and line[k:].lstrip()[:1].isalnum())


def _uses(columns: list[tuple[DataFrame, str]], bits: np.ndarray) -> DataFrame:
    """(line, how, use): lines before the last of all values that begin with (how 1, 2) or are (0) a line asked for; copies of a line are one."""
    out, shared = None, columns[0][0].sparkSession.sparkContext.broadcast(bits.astype(np.uint32))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        got, asked, uses = set(), [], []
        for raw in b["_t"]:
            lines = [x for x in map(str.strip, utf8(raw).split("\n")) if x]
            for n, x in enumerate(lines):
                tags = _tags(x) if x[0] in "#@" else []
                # of the last line only the tags before the last one
                for t in (tags[:-1] if n == len(lines) - 1 else tags or [_plain(x)]):
                    asked.append(t)
                    uses.append((lines[n - 1] if n else "", x))
        for i, k in zip(*_starts(asked, shared.value)) if asked else ():
            t, (before, x) = asked[i], uses[i]
            if k == len(t):
                got.add((key128(t), 0, key128(f"{before}\n{x}")))
            elif how := _goes_on(t, k):
                got.add((key128(t[:k]), how, key128(x)))
        return pd.DataFrame(list(got), columns=["line", "how", "use"])

    for df, text in columns:
        one = df.select(F.col(text).alias("_t")).where("_t IS NOT NULL").mapInPandas(per_batch(run), "line binary, how int, use binary")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def cut_lines(rows: DataFrame, columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """(verdict, whole) of the last lines left open in ``rows`` (written; with verdict and ``ASKED``) that are cuts; columns: the (frame, text) to count lines in.

    The driver sees one bit map of 2^BITS hashes, which only thins out what is shuffled.
    """
    open_ = rows.where("verdict > 1")
    words = open_.select(F.explode(F.array("bit", "whole_bit")).alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("v")).collect()
    bits = np.zeros(1 << BITS - 5, dtype="<u4")
    for r in words:
        bits[r["w"]] = r["v"]
    uses = _uses(columns, bits).groupBy("line").agg(F.count_if(F.col("how") > 0).alias("on"), F.count_if(F.col("how") == 2).alias("mid"), F.count_if(F.col("how") == 0).alias("alone"))
    texts = sum(df.agg(F.approx_count_distinct(F.xxhash64(text))).first()[0] for df, text in columns)
    uses = cut(uses, "uses")
    ends = open_.groupBy("verdict", "line", "whole").agg(F.countDistinct("class").alias("n"))
    per = ends.join(uses.select("line", "on", "mid"), "line", "left").join(uses.select(F.col("line").alias("whole"), "alone"), "whole", "left").fillna(0, ["on", "mid", "alone"])
    n = F.col("n") + F.col("alone")
    begun = (F.col("on") >= WORD * n) | ((2 * F.col("mid") > F.col("on")) & (F.col("on") >= MID * n))
    meant = (n >= 2) & (n >= RECUR * texts) & ~begun
    return per.where(F.when(F.col("verdict") == 2, ~meant).otherwise(begun)).select("verdict", "whole")


def cut_records(columns: list[tuple[DataFrame, str, str, str]], model: Backward, trees: BaggedTrees | None, spam_column: int | None, stripper: Stripper | None = None) -> DataFrame:
    """(table_name, rec_id) of cut values; columns: (frame, key, text, table name). The values are judged once and their lines counted once; only suspicious rows and lines they ask for are shuffled but for the texts themselves, whose copies count once."""
    values = [(df, text) for df, _, text, _ in columns]
    same = len(values) == len(model.columns) and all(a is b and t == u for (a, t), (b, u) in zip(values, model.columns))
    found = cut(suspects(model.rows if same else bodies(values, stripper, spam_column), model, trees), "verdicts")
    out = None
    for col, (df, key, text, name) in enumerate(columns):
        ids = df.select(F.col(key).cast("string").alias("rec_id"), digest(text).alias("h")).where("rec_id IS NOT NULL AND h IS NOT NULL")
        one = ids.join(found.where(F.col("col") == col).drop("col"), "h").drop("h").distinct().select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    rows = cut(out, "suspects")
    is_cut = cut_lines(rows, [(df, text) for df, _, text, _ in columns])
    return rows.where("verdict = 1").unionByName(rows.where("verdict > 1").join(is_cut, ["verdict", "whole"], "left_semi").select(rows.columns)).select("table_name", "rec_id").distinct()
