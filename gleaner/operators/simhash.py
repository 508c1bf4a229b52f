"""SimHash fingerprints and their banded Hamming join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut

BITS = 64


def tokens(text: Column) -> Column:
    """Latin tokens and bigrams of Han runs (single characters marked)."""

    def one(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
        return F.when(w.rlike("^[\\x{4e00}-\\x{9fff}]{2,}"), grams).when(w.rlike("^[\\x{4e00}-\\x{9fff}]$"), F.array(F.concat(F.lit("@"), w))).otherwise(F.array(w))

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_.+#-]*|[\\x{4e00}-\\x{9fff}]+"), F.lit(0)), one))


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fingerprint): signed 64-bit SimHash; features hash by an md5 prefix, each sighting weighs one. No features: 0.

    Row-local, without a shuffle: set bits are counted over the text's tokens in
    32 sums that hold two counters of 32 bits each; a bit is set where it
    outweighs the rest. Rows that repeat a key repeat its fingerprint.
    """
    half = "cast(conv(substring(md5(t), {}, 8), 16, 10) as bigint)"
    hashed = F.expr(f"transform(_t, t -> named_struct('hi', {half.format(1)}, 'lo', {half.format(9)}))")
    add = "aggregate(_h, array_repeat(0L, 32), (a, h) -> transform(a, (x, i) -> x + (shiftright(h.lo, i) & 1L) + shiftleft(shiftright(h.hi, i) & 1L, 32)))"
    bits = "aggregate(transform(_s, (x, i) -> if((x & 4294967295L) * 2 > size(_t), shiftleft(1L, i), 0L) | if(shiftrightunsigned(x, 32) * 2 > size(_t), shiftleft(1L, i + 32), 0L)), 0L, (a, x) -> a | x)"
    d = df.select(key, tokens(F.col(text)).alias("_t")).withColumn("_h", hashed).withColumn("_s", F.expr(add))
    return d.select(key, F.coalesce(F.expr(bits), F.lit(0).cast("bigint")).alias("fingerprint"))


IN_A_TASK = 500_000  # places of fingerprints under keys in one task
IN_A_PART = 1 << 18  # fingerprints under one choice of blocks in one part
SMALL = 64  # members of a key that are compared offset by offset, many keys at once
TILE = 1 << 22


def _choices(distance: int, shared: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """(masks of the blocks, choices of ``shared`` blocks in order)."""
    blocks = distance + shared
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])], list(combinations(range(blocks), shared))


def _meet(f: np.ndarray, mask: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Of fingerprints in the order of their bits in ``mask``: (a, b, True) places of near ones in short lists, (from, to, False) of each longer list."""
    key = f & np.uint64(mask)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(f)))
    short = np.repeat(size <= SMALL, size)
    after = np.repeat(start + size, size) - np.arange(len(f)) - 1
    at = np.flatnonzero(short & (after > 0))
    for t in range(1, SMALL):
        at = at[after[at] >= t]
        if not len(at):
            break
        near = at[np.bitwise_count(f[at] ^ f[at + t]) <= distance]
        if len(near):
            yield near, near + t, True
    for k in np.flatnonzero(size > SMALL):
        yield start[k : k + 1], start[k : k + 1] + size[k], False


def _parts(batches: Iterator[pa.RecordBatch], masks: list[int], chosen: list[tuple[int, ...]]) -> Iterator[tuple[int, np.ndarray]]:
    """(mask, fingerprints in its order) of each part of a task."""
    got: dict[int, list] = {}
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got.setdefault(part, []).append(blob)
    for part in sorted(got):
        f = np.frombuffer(b"".join(got.pop(part)), dtype=np.uint64)
        mask = sum(masks[i] for i in chosen[part % len(chosen)])
        yield part % len(chosen), f[np.argsort(f & np.uint64(mask), kind="stable")]


def _indexed(fps: DataFrame, distance: int, shared: int) -> DataFrame:
    """(part, fps): distinct fingerprints once a choice of blocks, those with equal bits there in one part; a task holds whole parts."""
    masks, chosen = _choices(distance, shared)
    # equal fingerprints are collapsed first, so one shared by a third of all rows is one row here
    d = cut(fps.where("fingerprint IS NOT NULL").select("fingerprint").distinct(), "fingerprints")
    n = d.count()
    ranges = n // IN_A_PART + 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy().view(np.uint64)
            parts, blobs = [], []
            for c, blocks in enumerate(chosen):
                with np.errstate(over="ignore"):
                    r = (((f & np.uint64(sum(masks[i] for i in blocks))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(ranges)
                for k in np.unique(r):
                    parts.append(int(k) * len(chosen) + c)
                    blobs.append(f[r == k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], ["part", "fps"])

    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, n * len(chosen) // IN_A_TASK)
    return d.mapInArrow(index, "part long, fps binary").repartition(tasks, "part")


def near_pairs(fps: DataFrame, distance: int = 3, shared: int | None = None) -> DataFrame:
    """(fp_a, fp_b, distance) of distinct fingerprints within a Hamming distance.

    The bits are cut into ``distance + shared`` blocks: two fingerprints that near
    have ``shared`` equal blocks at least, so every choice of ``shared`` blocks is a
    key. With three of nine blocks (distance 6) a key has 21 bits, so a key meets
    n / 2,000,000 others by chance where one band of nine bits met n / 512.
    A pair comes out only under the first choice it agrees in, so no pair comes
    twice and nothing but the index is shuffled; pairs leave a task in pieces.
    """
    shared = shared or 3
    masks, chosen = _choices(distance, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            x = a ^ b
            first = np.ones(len(x), dtype=bool)
            for i in range(chosen[c][-1]):
                if i not in chosen[c]:
                    first &= (x & np.uint64(masks[i])) != 0
            a, b, x = a[first].view(np.int64), b[first].view(np.int64), x[first]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.bitwise_count(x).astype(np.int32))], ["fp_a", "fp_b", "distance"])

        for c, f in _parts(batches, masks, chosen):
            for a, b, pairs in _meet(f, sum(masks[i] for i in chosen[c]), distance):
                if pairs:
                    yield out(c, f[a], f[b])
                    continue
                m = f[a[0] : b[0]]
                i = 0
                while i < len(m) - 1:
                    rows = m[i : i + max(1, min(512, TILE // (len(m) - i)))]
                    rest = m[i + 1 :]
                    u, v = np.nonzero(np.bitwise_count(rows[:, None] ^ rest[None, :]) <= distance)
                    later = v >= u  # a row meets those behind it
                    if later.any():
                        yield out(c, rows[u[later]], rest[v[later]])
                    i += len(rows)

    return _indexed(fps, distance, shared).mapInArrow(run, "fp_a long, fp_b long, distance int")


def near_links(fps: DataFrame, distance: int = 3, shared: int = 3) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs of :func:`near_pairs` do, at most one a fingerprint and task.

    Near fingerprints meet in a list of some choice; each list's members are
    followed from one to the next near one until all are reached, so a dense list
    of m members costs m links and not m²/2 pairs.
    """
    masks, chosen = _choices(distance, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, label = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for c, f in _parts(batches, masks, chosen):
            every = np.union1d(nodes, f)
            known = np.arange(len(every))
            if len(nodes):
                was = np.searchsorted(every, nodes)
                known[was] = was[label]
            nodes, label = every, known
            at = np.searchsorted(nodes, f)
            lists, x, y = [], [at[:0]], [at[:0]]
            for a, b, pairs in _meet(f, sum(masks[i] for i in chosen[c]), distance):
                if pairs:
                    x.append(at[a])
                    y.append(at[b])
                else:
                    lists.append((a[0], b[0]))
            label = _joined(label, np.concatenate(x), np.concatenate(y))
            for lo, hi in lists:
                own = at[lo:hi]
                if (label[own] != label[own[0]]).any():
                    label = _joined(label, *_followed(nodes, label, own, distance))
        tied = np.flatnonzero(label != np.arange(len(label)))
        if len(tied):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[tied].view(np.int64)), pa.array(nodes[label[tied]].view(np.int64))], ["a", "b"])

    return _indexed(fps, distance, shared).mapInArrow(run, "a long, b long")


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each the place of its smallest fellow) after places x and y are tied."""
    label = label.copy()
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (label[label] != label).any():
            label = label[label]


def _followed(nodes: np.ndarray, label: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Ties between places of one list that are near and not tied so far."""
    x, y = [own[:0]], [own[:0]]
    rest = own
    while len(rest) > 1:
        seen = label[rest] == label[rest[0]]
        front, rest = rest[seen], rest[~seen]
        while len(front) and len(rest):
            rows, front = front[: max(1, TILE // len(rest))], front[max(1, TILE // len(rest)) :]
            near = np.bitwise_count(nodes[rows][:, None] ^ nodes[rest][None, :]) <= distance
            met = near.any(axis=0)
            if met.any():
                x.append(rest[met])
                y.append(rows[near[:, met].argmax(axis=0)])
                seen = np.isin(label[rest], label[rest[met]])
                front, rest = np.concatenate((front, rest[seen])), rest[~seen]
    return np.concatenate(x), np.concatenate(y)
