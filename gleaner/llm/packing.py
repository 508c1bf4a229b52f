"""Filling fixed-capacity containers with documents, sized in tokens of a public tokenizer.

Linear grouping: documents longer than ``SMALL`` of the capacity are sorted by
size and cut into ``GROUPS`` groups of equal cardinality, each size rounded up
to its group's largest. Configurations of the few rounded sizes are optimised
on the driver from counts alone (best-filling pattern by knapsack, taken as
often as the counts allow). Actual documents then take the places of their
group by rank, and small documents go best-fit, largest first, into what room
the actual sizes leave, shard by shard.

The driver sees a histogram of at most ``capacity`` sizes; everything on
documents, the counts per partition and group too, is distributed.

Defined cases: null texts and texts of no tokens need no room and have no rows;
a text above the capacity is split into pieces of exactly the capacity and one
rest, whose places are given by ``start_token``; equal sizes may go anywhere.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import per_batch
from gleaner.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: the public pattern that splits text before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GROUPS = 64
SMALL = 0.125
SHARD = 20_000


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n): tokens of each text."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        e = encoding(tokenizer)
        return pd.DataFrame({"_k": b["_k"], "n": [len(e.encode_ordinary(t)) for t in b["_t"]]})

    kind = dict(df.dtypes)[key]
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_k IS NOT NULL AND length(_t) > 0")
    return src.mapInPandas(per_batch(run), f"_k {kind}, n int").where("n > 0").select(F.col("_k").alias(key), "n")


def plan(hist: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, int]]]:
    """(lower bounds of the groups, ascending; rounded sizes; patterns as (documents of each group, times)).

    ``hist``: size -> count, sizes below the capacity. Sizes up to ``small * capacity`` are in no group.
    """
    sizes = np.array(sorted(s for s in hist if s > small * capacity), dtype=np.int64)
    if len(sizes) == 0:
        return np.array([capacity + 1]), np.zeros(0, dtype=np.int64), []
    counts = np.array([hist[int(s)] for s in sizes], dtype=np.int64)
    # equal cardinality; a size as frequent as half a group is a group of its own, so that nothing is rounded up past it
    card = max(1.0, counts.sum() / groups)
    first, filled, heavy = [], 0.0, True
    for k, n in enumerate(counts.tolist()):
        if heavy or filled + n > card or n >= card / 2:
            first.append(k)
            filled = 0.0
        filled += n
        heavy = n >= card / 2
    first = np.array(first)
    lower, upper = sizes[first], sizes[np.append(first[1:], len(sizes)) - 1]
    left = np.add.reduceat(counts, first).astype(np.int64)
    patterns = []
    while left.sum() > 0:
        p = _best_pattern(upper, left, capacity)
        times = int((left[p > 0] // p[p > 0]).min())
        patterns.append((p, times))
        left = left - p * times
    return lower, upper, patterns


def _best_pattern(size: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Places per group of a container that holds the largest group left and is then filled as far as can be."""
    out = np.zeros(len(size), dtype=np.int64)
    top = int(np.flatnonzero(left)[-1])
    out[top] = 1
    room = capacity - int(size[top])
    # bounded knapsack on what remains: reach[r] is the last group used to fill exactly r, larger groups first
    reach = np.full(room + 1, -1, dtype=np.int64)
    reach[0] = -2
    used = np.zeros(room + 1, dtype=np.int64)
    for g in range(top, -1, -1):
        s, n = int(size[g]), int(left[g]) - (1 if g == top else 0)
        if n <= 0 or s > room:
            continue
        # a group's places in a pattern are limited so that the pattern can be taken many times
        most = min(n, room // s, max(1, n // 4) if n > 8 else n)
        have = reach != -1
        for k in range(1, most + 1):
            to = np.flatnonzero(have[: room + 1 - k * s]) + k * s
            to = to[reach[to] == -1]
            reach[to], used[to] = g, k
    r = int(np.flatnonzero(reach != -1)[-1])
    while r > 0:
        g, k = int(reach[r]), int(used[r])
        out[g] += k
        r -= k * int(size[g])
    return out


def best_fit(room_ids: list, rooms: list[int], ids: list, sizes: list[int], capacity: int, name) -> list:
    """Container of each document: largest first into the tightest room that takes it, else a new container ``name(k)``."""
    free = sorted((r, k) for k, r in enumerate(rooms))
    owner = list(room_ids)
    out = [None] * len(ids)
    for j in sorted(range(len(ids)), key=lambda j: (-sizes[j], ids[j])):
        at = bisect_left(free, (sizes[j], -1))
        if at < len(free):
            r, k = free.pop(at)
        else:
            r, k = capacity, len(owner)
            owner.append(name(k))
        out[j] = owner[k]
        if r > sizes[j]:
            insort(free, (r - sizes[j], k))
    return out


def pack(counts: DataFrame, key: str, kind: str, capacity: int, groups: int = GROUPS) -> DataFrame:
    """(container_kind, container_id, key, part_no, start_token, n_tokens); ``counts``: (key, n)."""
    spark = counts.sparkSession
    kt = dict(counts.dtypes)[key]
    c = capacity
    rest = counts.where(F.col("n") % c > 0).select(key, (F.col("n") % c).cast("int").alias("size"), F.floor(F.col("n") / c).cast("int").alias("part_no"))
    full = counts.where(F.col("n") >= c).select(key, F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / c).cast("int") - 1)).alias("part_no"))
    full = full.select(F.concat(F.lit("F"), F.col(key).cast("string"), F.lit("-"), F.col("part_no").cast("string")).alias("container_id"), key, "part_no", F.lit(c).alias("size"))
    hist = {r["size"]: r["count"] for r in rest.groupBy("size").count().collect()}  # at most `capacity` rows
    lower, upper, patterns = plan(hist, c, groups)

    def place(batches):
        seen = np.zeros(len(lower) + 1, dtype=np.int64)
        for b in batches:
            g = np.searchsorted(lower, b["size"].to_numpy(), side="right") - 1
            rank = np.zeros(len(b), dtype=np.int64)
            for x in np.unique(g):
                m = g == x
                rank[m] = seen[x] + np.arange(m.sum())
                seen[x] += m.sum()
            yield b.assign(grp=g.astype(np.int32), rank=rank)

    ranked = cut(rest.mapInPandas(place, f"{key} {kt}, size int, part_no int, grp int, rank long").withColumn("_p", F.spark_partition_id()), "ranked")
    large = ranked.where("grp >= 0")
    # a document's rank within its group: its rank within the partition behind those of the partitions before
    # (counts per partition and group stay a table; a group's counts are few, one a partition)
    before = Window.partitionBy("grp").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = large.groupBy("_p", "grp").agg(F.count("*").alias("_c")).select("_p", "grp", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("first"))
    large = large.join(start, ["_p", "grp"])
    base = np.concatenate(([0], np.cumsum([t for _, t in patterns]))).astype(np.int64)
    slots = {g: [(i, int(p[g]), t) for i, (p, t) in enumerate(patterns) if p[g]] for g in range(len(upper))}
    table = {g: (np.cumsum([k * t for _, k, t in v]), np.array([i for i, _, _ in v]), np.array([k for _, k, _ in v])) for g, v in slots.items()}

    def seat(b: pd.DataFrame) -> pd.DataFrame:
        no = np.zeros(len(b), dtype=np.int64)
        place = b["rank"].to_numpy() + b["first"].to_numpy()
        for g, rows in b.groupby("grp").indices.items():
            cum, pat, each = table[g]
            r = place[rows]
            k = np.searchsorted(cum, r, side="right")
            off = r - np.where(k > 0, cum[k - 1], 0)
            no[rows] = base[pat[k]] + off // each[k]
        return pd.DataFrame({key: b[key], "size": b["size"], "part_no": b["part_no"], "no": no})

    seated = large.mapInPandas(per_batch(seat), f"{key} {kt}, size int, part_no int, no long")
    rooms = seated.groupBy("no").agg((F.lit(c) - F.sum("size")).cast("int").alias("room")).where("room > 0")
    n_small = sum(n for s, n in hist.items() if s < int(lower[0])) if len(upper) else sum(hist.values())
    shards = int(max(base[-1], n_small) // SHARD + 1)
    a = rooms.select(F.pmod(F.xxhash64("no"), F.lit(shards)).cast("int").alias("shard"), F.col("no"), F.col("room").alias("size"), F.lit(None).cast(kt).alias(key), F.lit(None).cast("int").alias("part_no"))
    b = ranked.where("grp < 0").select(F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("no"), "size", key, "part_no")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        r, d = pdf[pdf["no"].notna()], pdf[pdf["no"].isna()]
        s = int(pdf["shard"].iloc[0])
        got = best_fit([f"L{int(x)}" for x in r["no"]], r["size"].tolist(), d[key].tolist(), d["size"].tolist(), c, lambda k: f"S{s}-{k}")
        return pd.DataFrame({"container_id": got, key: d[key], "part_no": d["part_no"].astype("int32"), "size": d["size"]})

    small = a.unionByName(b).groupBy("shard").applyInPandas(fill, f"container_id string, {key} {kt}, part_no int, size int")
    out = full.unionByName(seated.select(F.concat(F.lit("L"), F.col("no").cast("string")).alias("container_id"), key, "part_no", "size")).unionByName(small)
    return out.select(F.lit(kind).alias("container_kind"), "container_id", key, "part_no", (F.col("part_no") * c).alias("start_token"), F.col("size").alias("n_tokens"))


def assignment(docs: DataFrame, key: str, text: str, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The packing of every text into containers of every kind (kinds are a small fixed table)."""
    counts = cut(token_counts(docs, key, text, tokenizer), "tokens")
    out = None
    for r in containers.where("container_kind IS NOT NULL AND capacity_tokens > 0").distinct().orderBy("container_kind").collect():
        one = pack(counts, key, r["container_kind"], r["capacity_tokens"])
        out = one if out is None else out.unionByName(one)
    return out
