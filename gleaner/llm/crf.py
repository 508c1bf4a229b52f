"""A linear-chain conditional random field with two labels.

Emissions are sums over hashed binary features of a block; transitions depend
on a small edge class between neighbours. Fitted by stochastic gradient ascent
on the conditional log-likelihood of the labels that are known: a block may be
left open, then both of its labels are summed over (expected counts under the
known labels, less those without them). Decoded by Viterbi.

:func:`fit_whole` fits over all rows of a table instead: the likelihood and its
gradient are summed by the tasks at every step of L-BFGS on the driver, which
sees one vector of weights a task. The penalty of a weight grows with the blocks
that hold its feature, as in the stochastic form.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gleaner.llm.common import per_batch
from gleaner.session import cut, drop

DIM = 1 << 15
OPEN = -1


class Chain:
    """weights: emission (DIM,) as the log-odds of label 1; trans (edges, 2, 2); start (2,), end (2,)."""

    def __init__(self, edges: int) -> None:
        self.w = np.zeros(DIM)
        self.trans = np.zeros((edges, 2, 2))
        self.start = np.zeros(2)
        self.end = np.zeros(2)

    def emissions(self, feats: list[list[int]]) -> np.ndarray:
        n = [len(f) for f in feats]
        flat = np.fromiter((x for f in feats for x in f), dtype=np.int64, count=sum(n))
        at = np.repeat(np.arange(len(feats)), n)
        return np.bincount(at, weights=self.w[flat], minlength=len(feats))

    def decode(self, score: np.ndarray, edge: list[int]) -> list[int]:
        """Viterbi path; ``edge[t]`` is the edge class between block t-1 and t."""
        t00, t01, t10, t11 = (self.trans[:, a, b].tolist() for a in (0, 1) for b in (0, 1))
        a, b = float(self.start[0]), float(self.start[1]) + float(score[0])
        back = []
        for s, e in zip(score[1:].tolist(), edge[1:]):
            x0, x1, y0, y1 = a + t00[e], b + t10[e], a + t01[e], b + t11[e]
            back.append((x1 > x0, y1 > y0))
            a, b = (x1 if x1 > x0 else x0), (y1 if y1 > y0 else y0) + s
        at = int(b + self.end[1] > a + self.end[0])
        out = [at]
        for p in reversed(back):
            at = int(p[at])
            out.append(at)
        return out[::-1]

    def _expected(self, psi: list[float], edge: list[int], known: list[int] | None, trans: list, dt: np.ndarray, sign: float) -> list[float]:
        """P(label 1) of each block; adds the expected transitions to ``dt``. ``known``: labels to hold to."""
        n = len(psi)
        fit0 = [1.0 if known is None or known[t] != 1 else 0.0 for t in range(n)]
        fit1 = [psi[t] if known is None or known[t] != 0 else 0.0 for t in range(n)]
        a0, a1 = exp(self.start[0]) * fit0[0], exp(self.start[1]) * fit1[0]
        z = a0 + a1
        fw = [(a0 / z, a1 / z)]
        norm = [1.0]
        for t in range(1, n):
            (p0, p1), k = fw[-1], trans[edge[t]]
            a0, a1 = (p0 * k[0] + p1 * k[2]) * fit0[t], (p0 * k[1] + p1 * k[3]) * fit1[t]
            z = a0 + a1
            fw.append((a0 / z, a1 / z))
            norm.append(z)
        b0, b1 = exp(self.end[0]), exp(self.end[1])
        last = fw[-1][0] * b0 + fw[-1][1] * b1
        b0, b1 = b0 / last, b1 / last
        p = [0.0] * n
        for t in range(n - 1, -1, -1):
            p[t] = fw[t][1] * b1
            if t:
                (p0, p1), k, z = fw[t - 1], trans[edge[t]], norm[t]
                c0, c1 = fit0[t] * b0 / z, fit1[t] * b1 / z
                d = dt[edge[t]]
                d[0] += sign * p0 * k[0] * c0
                d[1] += sign * p0 * k[1] * c1
                d[2] += sign * p1 * k[2] * c0
                d[3] += sign * p1 * k[3] * c1
                b0, b1 = k[0] * c0 + k[1] * c1, k[2] * c0 + k[3] * c1
        return p

    def fit(self, pages: list[tuple[list[list[int]], list[int], list[int]]], epochs: int = 10, rate: float = 0.3, l2: float = 1e-4, seed: int = 3) -> Chain:
        """pages: (features, edge classes, labels) of each page; label ``OPEN`` where it is not known."""
        rng = np.random.default_rng(seed)
        edges = len(self.trans)
        gw, gt, gs, ge = np.full(DIM, 1e-6), np.full((edges, 4), 1e-6), np.full(2, 1e-6), np.full(2, 1e-6)
        flat = [(np.fromiter((x for f in feats for x in f), dtype=np.int64), np.array([len(f) for f in feats]), edge, y) for feats, edge, y in pages if len(feats)]
        grouped = [(*np.unique(idx, return_inverse=True), np.repeat(np.arange(len(n)), n), idx, edge, y) for idx, n, edge, y in flat]
        for _ in range(epochs):
            for k in rng.permutation(len(grouped)):
                u, inv, owner, idx, edge, y = grouped[k]
                s = np.bincount(owner, weights=self.w[idx], minlength=len(y))
                psi = np.exp(np.clip(s, -25, 25)).tolist()
                trans = np.exp(self.trans.reshape(-1, 4)).tolist()
                dt = [[0.0] * 4 for _ in range(edges)]
                free = self._expected(psi, edge, None, trans, dt, -1.0)
                held = self._expected(psi, edge, y, trans, dt, 1.0)
                d = np.array(held) - np.array(free)
                # AdaGrad on the features of this page
                gu = np.bincount(inv, weights=d[owner], minlength=len(u)) - l2 * self.w[u]
                gw[u] += gu * gu
                self.w[u] += rate * gu / np.sqrt(gw[u])
                dt = np.array(dt)
                gt += dt * dt
                self.trans += (rate * (dt - l2 * self.trans.reshape(-1, 4)) / np.sqrt(gt)).reshape(-1, 2, 2)
                for w, g, at in ((self.start, gs, 0), (self.end, ge, -1)):
                    d2 = np.array([free[at] - held[at], held[at] - free[at]])
                    g += d2 * d2
                    w += rate * d2 / np.sqrt(g)
        return self

    def vector(self) -> np.ndarray:
        return np.concatenate([self.w, self.trans.ravel(), self.start, self.end])

    def load(self, x: np.ndarray) -> Chain:
        n = self.trans.size
        self.w, self.trans, self.start, self.end = x[:DIM].copy(), x[DIM : DIM + n].reshape(self.trans.shape).copy(), x[DIM + n : DIM + n + 2].copy(), x[DIM + n + 2 :].copy()
        return self

    def scores(self, feats: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Emission of each block: flat features, their number per block."""
        out = np.zeros(len(n))
        for i, part in _pieces(n):
            some = np.flatnonzero(m := n[i])
            if len(some):
                out[i.start + some] = np.add.reduceat(self.w.take(feats[part].astype(np.int64)), (np.cumsum(m) - m)[some])
        return out

    def paths(self, score: np.ndarray, edge: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Viterbi labels of the blocks of many pages, in the order of :func:`by_place`."""
        t00, t01, t10, t11 = self.trans.reshape(-1, 4).T[:, edge]
        off = np.concatenate(([0], np.cumsum(live))).tolist()
        a, b = np.full(live[0], self.start[0]), self.start[1] + score[: live[0]]
        back, ends = np.zeros((2, len(score)), dtype=bool), np.zeros(live[0], dtype=bool)
        for t, m in enumerate([*live.tolist()[1:], 0], 1):
            ends[m : len(a)] = b[m:] + self.end[1] > a[m:] + self.end[0]
            if m:
                i, a, b = slice(off[t], off[t + 1]), a[:m], b[:m]
                x0, x1, y0, y1 = a + t00[i], b + t10[i], a + t01[i], b + t11[i]
                back[0, i], back[1, i] = x1 > x0, y1 > y0
                a, b = np.where(x1 > x0, x1, x0), np.where(y1 > y0, y1, y0) + score[i]
        out, at = np.empty(len(score), dtype=np.uint8), ends
        for t in range(len(live) - 1, -1, -1):
            i, m = slice(off[t], off[t + 1]), live[t]
            out[i] = at[:m]
            at[:m] = np.where(at[:m], back[1, i], back[0, i])
        return out

    def _all_expected(self, fit0: np.ndarray, fit1: np.ndarray, edge: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(label 1) of every block, expected transitions of every block (4 each) and the sums of the log normalisers; ``fit0``, ``fit1`` have one row for each way to hold to labels."""
        k00, k01, k10, k11 = np.exp(self.trans.reshape(-1, 4)).T[:, edge]
        f0, f1, z = np.empty_like(fit0), np.empty_like(fit0), np.empty_like(fit0)
        off, live = np.concatenate(([0], np.cumsum(live))).tolist(), live.tolist() + [0]
        i = slice(0, live[0])
        a0, a1 = exp(self.start[0]) * fit0[:, i], exp(self.start[1]) * fit1[:, i]
        z[:, i] = s = a0 + a1
        f0[:, i], f1[:, i] = a0 / s, a1 / s
        for t in range(1, len(live) - 1):
            i, j = slice(off[t], off[t + 1]), slice(off[t - 1], off[t - 1] + live[t])
            p0, p1 = f0[:, j], f1[:, j]
            a0, a1 = (p0 * k00[i] + p1 * k10[i]) * fit0[:, i], (p0 * k01[i] + p1 * k11[i]) * fit1[:, i]
            z[:, i] = s = a0 + a1
            f0[:, i], f1[:, i] = a0 / s, a1 / s
        b0, b1, c0, c1 = np.empty_like(fit0), np.empty_like(fit0), np.empty_like(fit0), np.empty_like(fit0)
        norm = np.log(z).sum(axis=1)
        for t in range(len(live) - 2, -1, -1):
            i, last = slice(off[t], off[t + 1]), slice(off[t] + live[t + 1], off[t + 1])
            done = f0[:, last] * exp(self.end[0]) + f1[:, last] * exp(self.end[1])
            b0[:, last], b1[:, last] = exp(self.end[0]) / done, exp(self.end[1]) / done
            norm += np.log(done).sum(axis=1)
            if t:
                j = slice(off[t - 1], off[t - 1] + live[t])
                c0[:, i], c1[:, i] = x0, x1 = fit0[:, i] * b0[:, i] / z[:, i], fit1[:, i] * b1[:, i] / z[:, i]
                b0[:, j], b1[:, j] = k00[i] * x0 + k01[i] * x1, k10[i] * x0 + k11[i] * x1
        rest = slice(live[0], None)
        before = np.concatenate([np.arange(off[t - 1], off[t - 1] + live[t]) for t in range(1, len(live))]).astype(np.int64)
        p0, p1, c0, c1 = f0[:, before], f1[:, before], c0[:, rest], c1[:, rest]
        return f1 * b1, np.stack([p0 * c0 * k00[rest], p0 * c1 * k01[rest], p1 * c0 * k10[rest], p1 * c1 * k11[rest]]), norm

    def slope(self, feats: np.ndarray, n: np.ndarray, edge: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[float, np.ndarray]:
        """(log-likelihood of the known labels, its gradient) of pages in flat arrays: features, their number per block, edge class and label of each block, blocks per page."""
        return self.slope_by_place(*by_place(feats, n, edge, y, size))

    def slope_by_place(self, feats: np.ndarray, n: np.ndarray, edge: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, np.ndarray]:
        """:meth:`slope` of arrays in the order of :func:`by_place`."""
        psi = np.exp(np.clip(self.scores(feats, n), -25, 25))
        (free, held), moves, (z, zy) = self._all_expected(np.stack([np.ones(len(n)), y != 1]), np.stack([psi, np.where(y != 0, psi, 0.0)]), edge, live)
        d = held - free
        last = np.cumsum(live) - live + np.append(live[1:], 0)
        a, b = d[: live[0]].sum(), sum(d[i:j].sum() for i, j in zip(last.tolist(), np.cumsum(live).tolist()))
        went = np.column_stack([np.bincount(edge[live[0] :], weights=m[1] - m[0], minlength=len(self.trans)) for m in moves])
        g = np.zeros(DIM)
        for i, part in _pieces(n):
            g += np.bincount(feats[part].astype(np.int64), weights=np.repeat(d[i], n[i]), minlength=DIM)
        return float(zy - z), np.concatenate([g, went.ravel(), [-a, a, -b, b]])


def _pieces(n: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[slice, slice]]:
    """(blocks, their features) of about ``most`` features at a time, which the caches hold; ``n``: features per block."""
    end = np.cumsum(n)
    edges = np.unique(np.append(np.searchsorted(end, np.arange(0, int(n.sum()), most)), len(n)))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield slice(i, j), slice(int(end[i] - n[i]), int(end[j - 1]))


def places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block of each place, pages with a first, a second ... block): the first blocks of all pages, longest pages first, then their second ones and so on, so that a step along all pages is a step between slices."""
    order = np.argsort(-size, kind="stable")
    live = np.cumsum(np.bincount(size)[::-1])[::-1][1:]
    rank = np.empty(len(size), dtype=np.int64)
    rank[order] = np.arange(len(size))
    t = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.empty(len(t), dtype=np.int64)
    at[(np.cumsum(live) - live)[t] + np.repeat(rank, size)] = np.arange(len(t))
    return at, live


def by_place(feats: np.ndarray, n: np.ndarray, edge: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features, their number, edge class and label of the blocks in the order of :func:`places`, and its ``live``."""
    at, live = places(size)
    n = n.astype(np.int64)
    m = n[at]
    f = np.repeat((np.cumsum(n) - n)[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    return feats[f], m, edge[at], y[at], live


PAGES = "f binary, n binary, e binary, y binary"  # uint16 features, uint32 features per block, uint8 edge classes, int8 labels of a page
KINDS = (np.uint16, np.uint32, np.uint8, np.int8, np.uint32)
STEPS = 24


def fit_whole(pages: DataFrame, edges: int, steps: int = STEPS, l2: float = 1e-4, memory: int = 8) -> Chain:
    """The chain over all rows of a written table ``PAGES``."""

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        at = np.cumsum([len(f) for f in b["f"]]) // (1 << 21)  # about a million features at a time
        for _, g in b.groupby(at):
            f, n, e, y = (np.frombuffer(b"".join(g[c]), dtype=t) for c, t in (("f", np.uint16), ("n", np.uint32), ("e", np.uint8), ("y", np.int8)))
            out.append([x.astype(t).tobytes() for x, t in zip(by_place(f, n.astype(np.int64), e, y, np.array([len(x) for x in g["e"]])), KINDS)])
        return pd.DataFrame(out, columns=["f", "n", "e", "y", "live"])

    # pages in the order the steps need, once for all of them
    packed = cut(pages.mapInPandas(per_batch(pack), PAGES + ", live binary"), "packed")

    def total(step) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = None
            for b in batches:
                for row in zip(*(b[c] for c in ("f", "n", "e", "y", "live"))):
                    v = step(*(np.frombuffer(x, dtype=t).astype(np.int64 if t in (np.uint32, np.uint8) else t, copy=False) for x, t in zip(row, KINDS)))
                    out = v if out is None else out + v
            if out is not None:
                yield pd.DataFrame({"v": [out.astype(float).tobytes()]})

        rows = packed.mapInPandas(run, "v binary").collect()  # one vector a task
        return sum((np.frombuffer(r["v"]) for r in rows), np.zeros(1))

    fixed = Chain(edges)
    seen = total(lambda f, n, e, y, live: np.concatenate([[live[0], len(n)], np.bincount(f, minlength=DIM)]))
    if len(seen) == 1:
        drop(packed)
        return fixed
    count, blocks = seen[:2]
    weight = np.concatenate([seen[2:], np.full(edges * 4, blocks), np.full(4, count)]) / count
    scale = 1 / np.sqrt(np.maximum(weight, 1 / count))

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        at = x * scale

        def step(f, n, e, y, live):
            v, g = Chain(edges).load(at).slope_by_place(f, n, e, y, live)
            return np.concatenate([[v], g])

        got = total(step) / count
        return -got[0] + l2 / 2 * float((weight * at * at).sum()), (l2 * weight * at - got[1:]) * scale

    x = fixed.vector()
    v, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    left = steps
    while left > 0 and np.abs(g).max() > 1e-5:
        d, used = -g, []
        for s, u in reversed(past):
            a = (s @ d) / (s @ u)
            used.append(a)
            d = d - a * u
        if past:
            s, u = past[-1]
            d = d * ((s @ u) / (u @ u))
        for (s, u), a in zip(past, reversed(used)):
            d = d + s * (a - (u @ d) / (s @ u))
        t = 1.0 if past else min(1.0, 1.0 / np.linalg.norm(g))
        while left > 0:
            left -= 1
            w, h = value(x + t * d)
            if w <= v + 1e-4 * t * (g @ d):
                break
            t /= 3
        else:
            break
        s, u = t * d, h - g
        if s @ u > 1e-12:
            past = (past + [(s, u)])[-memory:]
        x, v, g = x + t * d, w, h
    drop(packed)
    return fixed.load(x * scale)
