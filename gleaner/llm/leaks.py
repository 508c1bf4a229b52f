"""Evaluation texts leaking into training text.

A generalised suffix automaton is built over the normalised tokens of the test
passages. Each document's tokens are turned to numbers once and streamed through
it; wherever the longest match ends with at least ``least`` tokens, its places
in the passages are noted. A document leaks a passage if matches in the
passage's order and in one place cover at least ``share`` of the passage's
tokens. What is removed are the spans of the document such matches lie in, and
any single match of ``span`` tokens.

The passages are a stated query set: they are collected in blocks of at most
``block`` tokens, one automaton each, built once on the driver and broadcast in
arrays of two numbers a state (states with several ways on keep a small
dictionary); one pass over the documents runs every block.

Defined cases: null or blank documents and passages match nothing; passages of
fewer than ``least`` tokens match nothing; repeated rows give one result row.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import per_batch, utf8
from gleaner.llm.normalise import canonical

LEAST = 4
SHARE = 0.5
_BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 500_000
AT_ONCE = 4  # blocks in one pass over the documents
SPAN = 50  # a single match of so many tokens is removed whatever share of a passage it is
_PIECE = re.compile(r"[぀-ヿ一-鿿]|[^\s぀-ヿ一-鿿]+\s*|\s+")
_TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W_぀-ヿ一-鿿]+")


def tokens(s: str) -> list[str]:
    return _TOKEN.findall(canonical(s, fold=True))


class Automaton:
    """Suffix automaton over token numbers of several passages, kept apart by restarting at the root."""

    def __init__(self, passages: list[tuple[int, list[str]]], least: int) -> None:
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []
        self.ids: list[int] = []
        self.least = least
        prefix: list[tuple[int, int, int]] = []
        for no, (pid, toks) in enumerate(passages):
            self.ids.append(pid)
            self.sizes.append(len(toks))
            last = 0
            for pos, t in enumerate(toks):
                last = self._extend(last, self.words.setdefault(t, len(self.words)))
                prefix.append((last, no, pos))
        for state, no, pos in prefix:
            while state > 0 and self.len[state] >= least:
                self.ends.setdefault(state, []).append((no, pos))
                state = self.link[state]
        grams = [self._grams(np.array(self.numbers(toks), dtype=np.int64)) for _, toks in passages]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self._pack()

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of all runs of ``least`` tokens."""
        n = len(ids) - self.least + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.least):
                h = h * _BASE + (ids[j : j + n] + 2).astype(np.uint64)
        return h

    def _pack(self) -> None:
        """Flat arrays: the only way on of a state (most have one), a dictionary for those with several."""
        n = len(self.next)
        self.tok, self.to = array("i", [-1]) * n, array("i", [-1]) * n
        self.branch = {}
        for k, d in enumerate(self.next):
            if len(d) == 1:
                (self.tok[k], self.to[k]), = d.items()
            elif d:
                self.branch[k] = d
        self.link, self.len = array("i", self.link), array("i", self.len)
        del self.next

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def numbers(self, toks: list[str]) -> list[int]:
        get = self.words.get
        return [get(t, -1) for t in toks]

    def matches(self, ids: list[int]) -> list[tuple[int, int, int]]:
        """(end position in the document, length, state) wherever a longest match of at least ``least`` tokens ends."""
        out = []
        least = self.least
        # every run of ``least`` tokens within a match is one of a passage, so only where such runs follow one another can a match lie
        h = self._grams(np.array(ids, dtype=np.int64))
        if not len(h) or not len(self.grams):
            return out
        hit = np.flatnonzero(self.grams[np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)] == h)
        if not len(hit):
            return out
        new = np.flatnonzero(np.concatenate(([True], np.diff(hit) > 1)))
        tok, to, branch, link, length = self.tok, self.to, self.branch, self.link, self.len
        for s, e in zip(hit[new].tolist(), (hit[np.append(new[1:], len(hit)) - 1] + least).tolist()):
            state = ln = 0
            for i in range(s, e):
                c = ids[i]
                nxt = to[state] if tok[state] == c else branch[state].get(c, -1) if state in branch else -1
                if nxt >= 0:
                    state, ln = nxt, ln + 1
                    continue
                if ln >= least:
                    out.append((i - 1, ln, state))
                while state > 0 and nxt < 0:
                    state = link[state]
                    ln = length[state]
                    nxt = to[state] if tok[state] == c else branch[state].get(c, -1) if state in branch else -1
                state, ln = (nxt, ln + 1) if nxt >= 0 else (0, 0)
            if ln >= least:
                out.append((e - 1, ln, state))
        return out

    def leaked(self, toks: list[str], share: float) -> list[tuple[int, float]]:
        """(passage id, covered share) of every passage of which the document holds enough."""
        found = self.matches(self.numbers(toks))
        return self._held(found, share) if found else []

    def _places(self, found: list[tuple[int, int, int]], share: float) -> dict[int, list[tuple[int, int, int]]]:
        """Segments (document start, passage start, length) of each passage of which the matches could cover enough."""
        if sum(n for _, n, _ in found) < share * min(self.sizes):  # not enough for the shortest passage
            return {}
        total: dict[int, int] = {}
        for at, (end, ln, state) in enumerate(found):
            while state > 0 and self.len[state] < self.least:
                state = self.link[state]
            found[at] = end, ln, state
            for no, _ in self.ends.get(state, ()):
                total[no] = total.get(no, 0) + ln
        per = {no: [] for no, n in total.items() if n >= share * self.sizes[no]}
        if per:
            for end, ln, state in found:
                for no, pos in self.ends.get(state, ()):
                    if no in per:
                        per[no].append((end - ln + 1, pos - ln + 1, ln))
        return per

    def _held(self, found: list[tuple[int, int, int]], share: float) -> list[tuple[int, float]]:
        out = []
        for no, segs in self._places(found, share).items():
            best = chain(segs, self.sizes[no])
            if best >= share * self.sizes[no]:
                out.append((self.ids[no], best / self.sizes[no]))
        return out

    def spans(self, toks: list[str], share: float, span: int) -> list[tuple[int, int]]:
        """(first, past the last) token of what is to be removed from a document; spans do not overlap."""
        found = self.matches(self.numbers(toks))
        cut = [(end - ln + 1, end + 1) for end, ln, _ in found if ln >= span]
        for no, segs in (self._places(found, share).items() if found else ()):
            best, lo, hi = chain(segs, self.sizes[no], True)
            if best >= share * self.sizes[no]:
                cut.append((lo, hi))
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(cut):
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], hi))
            else:
                out.append((lo, hi))
        return out


def chain(segs: list[tuple[int, int, int]], size: int, where: bool = False):
    """Most passage tokens covered by segments (doc start, passage start, length) in order and within one place; with ``where`` also the document's tokens from and to."""
    segs = sorted(set(segs))
    reach = size + size // 2 + 40  # one place: the passage's length, half again and an inserted line
    best = [0] * len(segs)
    start = [0] * len(segs)
    top, lo, hi = 0, 0, 0
    for i, (d, p, n) in enumerate(segs):
        best[i], start[i] = n, d
        for j in range(i - 1, -1, -1):
            dj, pj, nj = segs[j]
            if d - dj > reach:
                break
            if p <= pj or d + n - start[j] > reach:
                continue
            gain = n - max(0, pj + nj - p, dj + nj - d)  # overlapping ends count once
            if gain > 0 and best[j] + gain > best[i]:
                best[i], start[i] = best[j] + gain, start[j]
        if best[i] > top:
            top, lo, hi = best[i], start[i], d + n
    return (min(top, size), lo, hi) if where else min(top, size)


def automata(passages: DataFrame, pid: str, passage: str, least: int = LEAST, block: int = BLOCK) -> list[Automaton]:
    """One automaton for each block of at most ``block`` tokens of the stated passages."""
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    room = block
    for r in passages.select(pid, passage).where(F.col(pid).isNotNull() & F.col(passage).isNotNull()).distinct().orderBy(pid).toLocalIterator():
        toks = tokens(r[1])
        if not toks:
            continue
        if len(toks) > room and blocks[-1]:
            blocks.append([])
            room = block
        blocks[-1].append((r[0], toks))
        room -= len(toks)
    return [Automaton(b, least) for b in blocks]


def _passes(docs: DataFrame, key: str, text: str, built: list[Automaton], fn, schema: str) -> DataFrame:
    """``fn(automata, key, text)`` over all documents, ``AT_ONCE`` automata a pass."""
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_k IS NOT NULL AND _t IS NOT NULL")
    names = [c.split()[0] for c in schema.split(", ")]
    out = None
    for at in range(0, len(built), AT_ONCE):
        shared = sc.broadcast(built[at : at + AT_ONCE])  # at most AT_ONCE * block tokens

        def run(b: pd.DataFrame, shared=shared) -> pd.DataFrame:
            return pd.DataFrame([row for k, t in zip(b["_k"], b["_t"]) for row in fn(shared.value, k, utf8(t))], columns=names)

        one = src.mapInPandas(per_batch(run), schema)
        out = one if out is None else out.unionByName(one)
    return out


def leaks(docs: DataFrame, key: str, text: str, passages: DataFrame, pid: str, passage: str, least: int = LEAST, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(key, pid, covered): documents that hold at least ``share`` of a passage."""

    def find(built: list[Automaton], k, t: str) -> list[tuple]:
        toks = tokens(t)
        return [(k, p, c) for a in built for p, c in a.leaked(toks, share)]

    schema = f"_k {dict(docs.dtypes)[key]}, _p {dict(passages.dtypes)[pid]}, covered double"
    out = _passes(docs, key, text, automata(passages, pid, passage, least, block), find, schema)
    return out.groupBy("_k", "_p").agg(F.max("covered").alias("covered")).select(F.col("_k").alias(key), F.col("_p").alias(pid), "covered")


def pieces(text: str) -> tuple[list[str], list[int]]:
    """(pieces of a text that make it up, tokens in each): words with the space behind them, single characters of Chinese."""
    got = _PIECE.findall(text)
    return got, [len(tokens(x)) for x in got]


def removed(docs: DataFrame, key: str, text: str, passages: DataFrame, pid: str, passage: str, least: int = LEAST, share: float = SHARE, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """(key, spans, removed_tokens, tokens, text): documents with something to remove, and what is left of them."""
    built = automata(passages, pid, passage, least, block)

    def strip(shared: list[Automaton], k, t: str) -> list[tuple]:
        toks = tokens(t)
        cut = sorted(x for a in shared for x in a.spans(toks, share, span))
        if not cut:
            return []
        gone = np.zeros(len(toks), dtype=bool)
        for lo, hi in cut:
            gone[lo:hi] = True
        got, sizes = pieces(t)
        left, at = [], 0
        for x, n in zip(got, sizes):
            # a piece goes if any of its tokens does; one without tokens goes with the token before it
            drop = gone[at : at + n].any() if n else bool(at and gone[min(at, len(gone)) - 1])
            if not drop:
                left.append(x)
            at += n
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1)
        return [(k, len(edges), int(gone.sum()), len(toks), "".join(left))]

    schema = f"_k {dict(docs.dtypes)[key]}, spans int, removed_tokens int, tokens int, text string"
    if len(built) > AT_ONCE:
        raise ValueError("raise block: what is removed must be known in one pass")
    return _passes(docs, key, text, built, strip, schema).dropDuplicates(["_k"]).withColumnRenamed("_k", key)
