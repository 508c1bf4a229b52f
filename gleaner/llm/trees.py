"""Bagged decision trees on numeric features, fitted on the driver from a bounded labelled sample, or (:func:`fit_whole`) over all rows, level by level from histograms that the tasks sum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import per_batch


class Tree:
    """A binary tree in arrays; leaves hold the share of positives."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> None:
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self._grow(x, y, depth, least, rng)

    def _grow(self, x, y, depth, least, rng) -> int:
        at = len(self.value)
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, float((y.sum() + 0.5) / (len(y) + 1)))):
            a.append(v)
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        base = y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(3, int(x.shape[1] ** 0.5) + 2), replace=False):
            o = np.argsort(x[:, f], kind="stable")
            v, c = x[o, f], np.cumsum(y[o])
            n = np.arange(1, len(y) + 1)
            ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= least) & (n[:-1] <= len(y) - least))
            if len(ok) == 0:
                continue
            pl, pr = c[ok] / n[ok], (c[-1] - c[ok]) / (len(y) - n[ok])
            w = n[ok] / len(y)
            gain = base - w * pl * (1 - pl) - (1 - w) * pr * (1 - pr)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
        if best[1] < 0:
            return at
        go = x[:, best[1]] <= best[2]
        self.feature[at], self.cut[at] = best[1], best[2]
        self.left[at] = self._grow(x[go], y[go], depth - 1, least, rng)
        self.right[at] = self._grow(x[~go], y[~go], depth - 1, least, rng)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, c, le, ri, v = (np.asarray(a) for a in (self.feature, self.cut, self.left, self.right, self.value))
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(f[at] >= 0)
            if len(inner) == 0:
                return v[at]
            n = at[inner]
            at[inner] = np.where(x[inner, f[n]] <= c[n], le[n], ri[n])


class BaggedTrees:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, least: int = 3, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.trees = []
        if len(pos) == 0 or len(neg) == 0:
            self.constant = float(len(pos) > 0)
            return
        self.constant = None
        votes, seen = np.zeros(len(y)), np.zeros(len(y))
        for _ in range(trees):
            # both classes in equal numbers in each bag
            n = min(max(len(pos), 200), 2000)
            pick = np.concatenate([rng.choice(pos, n), rng.choice(neg, n)])
            self.trees.append(Tree(x[pick], y[pick].astype(float), depth, least, rng))
            out = np.setdiff1d(np.arange(len(y)), pick)
            votes[out] += self.trees[-1].predict(x[out])
            seen[out] += 1
        # each row by the trees that did not see it: what the bag says of pages it was not fitted on
        self.out_of_bag = np.where(seen > 0, votes / np.maximum(seen, 1), y)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.mean([t.predict(x) for t in self.trees], axis=0)


BINS = 64  # of a feature: half of its bounds are quantiles of each class
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)])


def _times(key: np.ndarray, tree: int) -> np.ndarray:
    """How often a row is in a tree's bag: Poisson of mean 1, from the row's key alone."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")


def fit_whole(rows: DataFrame, trees: int = 25, depth: int = 6, least: int = 3, seed: int = 7) -> BaggedTrees:
    """Trees over all rows of a written table (k long, x array<double>, y int of 0 or 1); every row is in a bag as often as its key says, both classes weigh the same.

    The driver sees counts by tree, open node, feature tried and bin: their number doesn't grow with the rows.
    """
    out = BaggedTrees.__new__(BaggedTrees)
    out.trees, out.constant = [], None
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(count) < 2:
        out.constant = float(count.get(1, 0) > 0)
        return out
    width = len(rows.first()["x"])
    quantiles = [k / (BINS // 2) for k in range(1, BINS // 2)]
    got = rows.groupBy("y").agg(*(F.percentile_approx(F.col("x")[j], quantiles, 10000).alias(str(j)) for j in range(width))).collect()
    cuts = [np.unique(np.concatenate([r[str(j)] for r in got])) for j in range(width)]
    weight = np.array([sum(count.values()) / 2 / count[1], sum(count.values()) / 2 / count[0]])
    rng = np.random.default_rng(seed)
    tries = min(width, max(3, int(width**0.5) + 2))
    for _ in range(trees):
        t = Tree.__new__(Tree)
        t.feature, t.cut, t.left, t.right, t.value = [-1], [0.0], [-1], [-1], [0.5]
        out.trees.append(t)
    open_ = [(t, 0) for t in range(trees)]
    for _ in range(depth):
        picked = np.array([rng.choice(width, tries, replace=False) for _ in open_])
        shape = [(np.array(t.feature), np.array(t.cut), np.array(t.left), np.array(t.right)) for t in out.trees]

        def run(b: pd.DataFrame, open_=open_, picked=picked, shape=shape) -> pd.DataFrame:
            x, y, key = np.array(b["x"].tolist()), b["y"].to_numpy(), b["k"].to_numpy().view(np.uint64)
            code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
            sums = np.zeros((2, len(open_) * tries * BINS))
            for t, (f, c, le, ri) in enumerate(shape):
                mine = np.full(len(f), -1)
                for n, (u, node) in enumerate(open_):
                    if u == t:
                        mine[node] = n
                if (mine < 0).all():
                    continue
                at = np.zeros(len(x), dtype=np.int64)
                while len(inner := np.flatnonzero(f[at] >= 0)):
                    n = at[inner]
                    at[inner] = np.where(x[inner, f[n]] <= c[n], le[n], ri[n])
                times = _times(key, t)
                use = np.flatnonzero((mine[at] >= 0) & (times > 0))
                n = mine[at[use]]
                for j in range(tries):
                    slot = (n * tries + j) * BINS + code[use, picked[n, j]]
                    for label in (0, 1):
                        of = y[use] == label
                        sums[label] += np.bincount(slot[of], weights=times[use][of], minlength=sums.shape[1])
            some = np.flatnonzero(sums.sum(axis=0))
            return pd.DataFrame({"slot": some, "neg": sums[0, some], "pos": sums[1, some]})

        got = rows.mapInPandas(per_batch(run), "slot long, neg double, pos double").groupBy("slot").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow()
        n = np.zeros((len(open_) * tries * BINS, 2))
        n[got["slot"].to_numpy()] = np.column_stack([got["pos"].to_numpy(), got["neg"].to_numpy()])
        n = n.reshape(len(open_), tries, BINS, 2)
        after = []
        for (t, node), f, c in zip(open_, picked, n):
            tree, whole = out.trees[t], c[0].sum(axis=0)
            w = whole * weight
            tree.value[node] = float((w[0] + 0.5) / (w.sum() + 1))
            if whole.sum() < 2 * least or not whole.all():
                continue
            low = np.cumsum(c, axis=1)[:, :-1]
            a, b = low * weight, (whole - low) * weight
            ok = (low.sum(axis=2) >= least) & ((whole - low).sum(axis=2) >= least)
            na, nb = np.maximum(a.sum(axis=2), 1e-12), np.maximum(b.sum(axis=2), 1e-12)
            gain = w[0] * w[1] / w.sum() ** 2 - (a[..., 0] * a[..., 1] / na + b[..., 0] * b[..., 1] / nb) / w.sum()
            j, k = np.unravel_index(int(np.argmax(np.where(ok, gain, -1.0))), gain.shape)
            if not ok[j, k] or gain[j, k] <= 1e-9:
                continue
            tree.feature[node], tree.cut[node] = int(f[j]), float(cuts[f[j]][k])
            for side, v in ((tree.left, a[j, k]), (tree.right, b[j, k])):
                side[node] = len(tree.value)
                for column, x in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, float((v[0] + 0.5) / (v.sum() + 1)))):
                    column.append(x)
                after.append((t, side[node]))
        open_ = after
        if not open_:
            break
    return out
