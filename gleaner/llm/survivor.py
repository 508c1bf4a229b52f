"""Best representative of each duplicate group by skyline selection.

Every member of a group is graded on completeness (2: the story's whole text,
1: some of it, 0: nothing usable), recency and trust. The members no other
member beats on all three form the first dominance layer; taken away, the next
form the second, and so on. The survivor is the first layer's best by the
lexicographic policy (completeness, fetched last, trust, smallest id); each
further field of the merged record is its first usable value in layer order.

Layers are computed in two steps, by salted parts of a group and then by group:
a row within the first ``LAYERS`` layers of its group is within the first
``LAYERS`` of any part of it, so a hot group never comes to one task whole.
Groups with a field that all those layers leave empty and a deeper row holds get
their layers to the last one: from their different grades alone (three numbers
each, of one group in one task), by sweeps in the order of time.

Defined cases: rows without a group or an id take no part; replayed ids count
once (their latest row); null trust or time ranks lowest; ties go to the
smallest id; a group without a whole text still gets a merged record, but no
row in the query of whole texts; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import truncation
from gleaner.session import cut

WHOLE = 0.72
LAYERS = 3
PART = 5000


def text_grades(df: DataFrame, id_col: str, group_col: str, text_col: str, time_col: str, trust_col: str, model: truncation.Backward) -> DataFrame:
    """(id, grp, t, q, size, state): size of the body without furniture; state 0 unusable, 1 cut, 2 uncut. ``model``: fitted on ``text_col`` of ``df``, graded."""
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("grp"), F.unix_micros(time_col).alias("t"), F.col(trust_col).cast("double").alias("q"), truncation.digest(text_col).alias("h")).where("id IS NOT NULL AND grp IS NOT NULL")
    usable = model.rows.where("size > 0").select("h", "size")
    marked = usable.join(truncation.suspects(model.rows, model).drop("col"), "h", "left").fillna(0, ["verdict"])
    state = F.when(F.col("size").isNull(), 0).when(F.col("verdict") == 1, 1).otherwise(2)
    rows = src.join(marked, "h", "left").select("id", "grp", "t", "q", F.coalesce("size", F.lit(0)).alias("size"), state.alias("state"), F.coalesce("verdict", F.lit(0)).alias("verdict"), "line", "whole", "bit", "whole_bit", "class")
    rows = cut(rows, "marks")
    # last lines of a few words and ellipses are judged by counts over all texts
    is_cut = truncation.cut_lines(rows, [(df, text_col)]).withColumn("hit", F.lit(1))
    judged = rows.where("verdict > 1").join(is_cut, ["verdict", "whole"], "left").withColumn("state", F.when(F.col("hit") == 1, 1).otherwise(F.col("state")))
    names = ["id", "grp", "t", "q", "size", "state"]
    return rows.where("verdict < 2").select(names).unionByName(judged.select(names))


def completeness(grades: DataFrame) -> DataFrame:
    """(grp, id, comp, t, q) of distinct ids in groups of at least two."""
    one = grades.groupBy("grp", "id").agg(F.max(F.struct("t", "state", "size", "q")).alias("r")).select("grp", "id", "r.*")
    top = one.groupBy("grp").agg(F.max(F.when(F.col("state") > 0, F.col("size"))).alias("top"), F.count("*").alias("members")).where("members > 1")
    comp = F.when((F.col("state") == 2) & (F.col("size") >= WHOLE * F.col("top")), 2).when(F.col("state") > 0, 1).otherwise(0)
    return one.join(top, "grp").select("grp", "id", comp.alias("comp"), F.coalesce("t", F.lit(-(1 << 62))).alias("t"), F.coalesce("q", F.lit(-1.0)).alias("q"), "members")


def layers_of(comp: np.ndarray, t: np.ndarray, q: np.ndarray, most: int = LAYERS) -> np.ndarray:
    """Dominance layer (1 up to ``most``; 0: deeper) of each row; larger is better in all three."""
    order = np.lexsort((-q, -t, -comp))
    out = np.zeros(len(order), dtype=np.int64)
    fronts: list[list[int]] = [[] for _ in range(most)]
    for i in order:
        for k, front in enumerate(fronts):
            f = np.array(front, dtype=np.int64)
            beats = (comp[f] >= comp[i]) & (t[f] >= t[i]) & (q[f] >= q[i]) & ((comp[f] > comp[i]) | (t[f] > t[i]) | (q[f] > q[i]))
            if not beats.any():
                out[i] = k + 1
                front.append(int(i))
                break
    return out


def all_layers(comp: np.ndarray, t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dominance layer of each row however deep: one more than the deepest row that beats it.

    Completeness has few values. Each, from the best down, takes one sweep from the
    latest time over its rows and the finished ones above; a tree of maxima over
    trust gives the deepest layer among rows at least as trusted.
    """
    rank = len(q) - np.searchsorted(np.sort(q), q, side="right")  # rows with more trust; equal trust, equal rank
    out = np.zeros(len(comp), dtype=np.int64)
    for level in np.unique(comp)[::-1]:
        rows = np.flatnonzero(comp >= level)
        rows = rows[np.lexsort((-comp[rows], rank[rows], -t[rows]))]
        tree = [0] * (len(q) + 2)
        last, layer = None, 0
        for i in rows.tolist():
            at = rank[i] + 1
            if comp[i] == level:
                if last != (t[i], at):  # rows of the same grades share a layer
                    last, layer, k = (t[i], at), 0, int(at)
                    while k:
                        layer = max(layer, tree[k])
                        k -= k & -k
                    layer += 1
                out[i] = layer
            k, v = int(at), int(out[i])
            while k < len(tree):
                tree[k] = max(tree[k], v)
                k += k & -k
    return out


def _layered(cols: list[str], layers=layers_of):
    """Layers of each run of equal group keys in sorted batches; a run may go on into the next batch."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        lay = np.ones(1, dtype=np.int64) if len(g) == 1 else layers(g["comp"].to_numpy(), g["t"].to_numpy(), g["q"].to_numpy())
        return g.assign(layer=lay)[lay > 0]

    def run(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            key = b[cols].astype(str).agg("\x00".join, axis=1) if len(cols) > 1 else b[cols[0]]
            edge = np.flatnonzero(np.concatenate(([True], key.to_numpy()[1:] != key.to_numpy()[:-1])))
            done = [solve(b.iloc[s:e]) for s, e in zip(edge[:-1], edge[1:])]
            rest = b.iloc[edge[-1] :]
            if done:
                yield pd.concat(done)
        if rest is not None and len(rest):
            yield solve(rest)

    return run


def skyline(rows: DataFrame) -> DataFrame:
    """(grp, id, comp, t, q, layer) of the first layers of each group."""
    kind = "grp string, id string, comp int, t long, q double, members long, part int, layer long"
    salted = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / PART)).cast("int"))
    local = salted.repartition("grp", "part").sortWithinPartitions("grp", "part").mapInPandas(_layered(["grp", "part"]), kind).drop("layer")
    # groups of one part are done; only those of several parts meet again
    return local.repartition("grp").sortWithinPartitions("grp").mapInPandas(_layered(["grp"]), kind).select("grp", "id", "comp", "t", "q", "layer")


def policy():
    """Order of preference within a group, smallest first."""
    return F.struct(-F.col("comp"), -F.col("t"), -F.col("q"), F.col("id"))


def survivors(sky: DataFrame) -> DataFrame:
    """(grp, id): the survivor of each group that holds a whole text."""
    return sky.where("layer = 1 AND comp = 2").groupBy("grp").agg(F.min_by("id", policy()).alias("id"))


def merged(items: DataFrame, id_col: str, group_col: str, rows: DataFrame, sky: DataFrame, fields: dict) -> DataFrame:
    """One record per group: every field from the first layer, by policy, that has a usable value. ``fields``: name -> (value, usable)."""
    src = items.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("grp"), *[F.when(ok, v).alias(f"f_{k}") for k, (v, ok) in fields.items()])
    order = cut(rows.join(sky.select("grp", "id", "layer"), ["grp", "id"], "left"), "layers")
    # groups with a field that only rows below the first layers hold
    held = [F.min(F.when(F.col(f"f_{k}").isNotNull(), F.coalesce("layer", F.lit(LAYERS + 1)))) > LAYERS for k in fields]
    short = src.join(order.select("grp", "id", "layer"), ["grp", "id"]).groupBy("grp").agg(F.greatest(*held, F.lit(False)).alias("short")).where("short").select("grp")
    grades = order.join(short, "grp", "left_semi").select("grp", "comp", "t", "q").distinct()
    deep = grades.repartition("grp").sortWithinPartitions("grp").mapInPandas(_layered(["grp"], all_layers), "grp string, comp int, t long, q double, layer long").withColumnRenamed("layer", "deep")
    order = order.join(deep, ["grp", "comp", "t", "q"], "left").select("grp", "id", F.struct(F.coalesce("deep", "layer", F.lit(LAYERS + 1)).alias("l"), policy().alias("p")).alias("o"))
    order = cut(order, "order")
    all_ = src.join(order, ["grp", "id"])
    aggs = [F.min_by(f"f_{k}", F.when(F.col(f"f_{k}").isNotNull(), F.col("o"))).alias(k) for k in fields]
    return all_.groupBy("grp").agg(F.min_by("id", "o").alias("survivor_id"), F.countDistinct("id").alias("members"), *aggs)
