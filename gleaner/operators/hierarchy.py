"""Parent-child links to full hierarchies by pointer doubling.

Every node starts with a pointer to its parent. A round replaces the pointer by
the pointer of the node it leads to, so jumps double and a tree of depth d is
resolved after about log2(d) rounds. Nodes still open after a round that
resolves none can only be on, or below, a loop.

Defined cases
-------------
* null ids are dropped; a repeated id is one node.
* null, blank or zero parent references in all of a node's rows: the node that
  lists it among its replies (smallest id if several), else a root.
* references that denote no node of the table (the item, a deleted row): a root.
* several references that denote nodes: the smallest one, compared as strings.
* loops (also a node that answers itself): depth -1, root = smallest id on the
  loop, for the loop's nodes and all nodes below it; ``path`` is null there.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut, drop

BLANK = ("", "0")


def reference(raw: Column) -> Column:
    """A parent reference as its id: surrounding white space and an anchor (``#comment-17``, ``https://host/d/1#17``) are notation."""
    return F.regexp_replace(F.regexp_replace(raw, r"[\s\u00A0\u3000\u200B\uFEFF]+", ""), r"^[^#]*#(?:comment-)?", "")


def link_table(rows: DataFrame, id_col: str, parent_col: str, replies_col: str | None = None) -> DataFrame:
    """(id, parent): one row per distinct id; parent is null for roots."""
    src = rows.select(
        F.col(id_col).cast("string").alias("id"),
        reference(F.col(parent_col).cast("string")).alias("ref"),
        *([F.col(replies_col).alias("rep")] if replies_col else []),
    ).where("id IS NOT NULL")
    own = src.select("id", F.when(~F.col("ref").isin(*BLANK), F.col("ref")).alias("ref"), F.lit(True).alias("own"))
    if replies_col:
        rep = src.where(F.size("rep") > 0).select("id", F.explode("rep").alias("child"))
        rep = rep.select(reference(F.col("child")).alias("id"), F.col("id").alias("ref"), F.lit(False).alias("own"))
        own = own.unionByName(rep.where("id IS NOT NULL"))
    # one node: has it a row, which distinct references has it (few: as many as differing sightings), who lists it
    per = own.groupBy("id").agg(
        F.max("own").alias("node"),
        F.min(F.when(F.col("own"), F.col("ref"))).alias("lo"),
        F.max(F.when(F.col("own"), F.col("ref"))).alias("hi"),
        F.min(F.when(~F.col("own"), F.col("ref"))).alias("listed"),
    ).where("node")
    return per.select("id", F.coalesce("lo", "listed").alias("ref"), F.when(F.col("lo") != F.col("hi"), F.lit(True)).otherwise(F.lit(False)).alias("many"))


def resolve(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", replies_col: str | None = None, with_path: bool = False) -> DataFrame:
    """(id, root_id, node_depth[, path]) for every distinct id; see the module text for all cases.

    The join on a pointer may meet hot pointers (a comment with a third of all
    answers); these joins are left joins on numbers whose streamed side AQE
    splits. Rows that are resolved take no further part.
    """
    spark = rows.sparkSession
    links = link_table(rows, id_col, parent_col, replies_col)
    nodes = cut(links.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    ids = nodes.select(F.col("id").alias("pid"), F.col("nid").alias("ptr"))
    edges = nodes.where("ref IS NOT NULL").select("nid", "id", F.col("ref")).join(ids, F.col("ref") == F.col("pid"), "left")
    if nodes.where("many").limit(1).count():
        # differing references: look each of them up, keep the smallest that exists
        src = rows.select(F.col(id_col).cast("string").alias("cid"), reference(F.col(parent_col).cast("string")).alias("cref"))
        pairs = src.where(F.col("cref").isNotNull() & ~F.col("cref").isin(*BLANK)).distinct()
        found = pairs.join(nodes.where("many").select(F.col("id").alias("cid")), "cid").join(ids, F.col("cref") == F.col("pid"))
        best = found.groupBy("cid").agg(F.min_by("ptr", "pid").alias("p2"))
        edges = edges.select("nid", "id", "ptr").join(best, F.col("id") == F.col("cid"), "left").withColumn("ptr", F.coalesce("p2", "ptr"))
    par = edges.where("ptr IS NOT NULL").select(F.col("nid").alias("cn"), "ptr")
    seg = [F.array("id").alias("seg")] if with_path else []
    state = nodes.join(par, F.col("nid") == F.col("cn"), "left").select(
        "nid", F.coalesce("ptr", "nid").alias("ptr"),
        F.when(F.col("ptr").isNull(), 0).otherwise(1).alias("dist"),
        F.col("ptr").isNull().alias("done"), *seg,
    )
    first = cut(state, "state")
    # rows that are resolved stay in the table of the round that resolved them; a round writes only the rows it moved
    parts = [first]

    def now() -> DataFrame:
        out = parts[-1]
        for p in parts[:-1]:
            out = out.unionByName(p.where("done"))
        return out

    jump, before = 1, -1
    while True:
        left = parts[-1].where("NOT done").count()
        # a round that resolves nothing: every open row points at an open row, so all of them lead into loops;
        # once the jump is longer than their number each pointer rests on a loop
        if left == 0 or (left == before and jump > left):
            break
        before = left
        # one left join on the pointer moves every open row twice as far
        look = now().select(F.col("nid").alias("on"), F.col("ptr").alias("op"), F.col("dist").alias("od"), F.col("done").alias("oz"), *([F.col("seg").alias("os")] if with_path else []))
        moved = parts[-1].where("NOT done").join(look, F.col("ptr") == F.col("on"), "left").select(
            "nid", F.col("op").alias("ptr"), (F.col("dist") + F.col("od")).alias("dist"), F.col("oz").alias("done"),
            *([F.concat("os", "seg").alias("seg")] if with_path else []),
        )
        parts.append(cut(moved, "state"))
        jump *= 2
    state = now()
    names = nodes.select(F.col("nid").alias("rn"), F.col("id").alias("rid"))
    if left:
        loops = _loops(first, state.where("NOT done"), names)
        state = state.join(loops, "nid", "left").select(
            "nid", F.coalesce("loop_root", "ptr").alias("ptr"), F.when(F.col("done"), F.col("dist")).otherwise(F.lit(-1)).alias("dist"),
            *([F.when(F.col("done"), F.col("seg")).alias("seg")] if with_path else []),
        )
    out = (
        state.join(nodes.select(F.col("nid").alias("sn"), "id"), F.col("nid") == F.col("sn"))
        .join(names, F.col("ptr") == F.col("rn"))
        .select("id", F.col("rid").alias("root_id"), F.col("dist").cast("int").alias("node_depth"), *([F.col("seg").alias("path")] if with_path else []))
    )
    return out


def _loops(first: DataFrame, open_rows: DataFrame, names: DataFrame) -> DataFrame:
    """(nid, loop_root): for nodes on or below loops the node with the smallest id on their loop."""
    # after more jumps than open nodes every pointer rests on a loop, and every loop node is the pointer of some node of its loop
    open_ = cut(open_rows.select("nid", F.col("ptr").alias("entry")), "open")
    step = first.join(open_.select("nid"), "nid").select("nid", F.col("ptr").alias("nx"))
    on = open_.select(F.col("entry").alias("nid")).distinct()
    ring = step.join(on, "nid").join(names, F.col("nid") == F.col("rn")).select("nid", "nx", F.struct(F.col("rid").alias("i"), F.col("rn").alias("n")).alias("m"))
    ring = cut(ring, "ring")
    n, jump = ring.count(), 1
    while jump <= n:
        far = ring.select(F.col("nid").alias("k"), F.col("nx").alias("nx2"), F.col("m").alias("m2"))
        nxt = cut(ring.join(far, F.col("nx") == F.col("k")).select("nid", F.col("nx2").alias("nx"), F.least("m", "m2").alias("m")), "ring")
        drop(ring)
        ring, jump = nxt, jump * 2
    return open_.join(ring.select(F.col("nid").alias("entry"), F.col("m.n").alias("loop_root")), "entry").select("nid", "loop_root")


def chains(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", replies_col: str | None = None) -> DataFrame:
    """(id, root_id, node_depth, path): path is the array of ids from the root down, so ids may hold any sign."""
    return resolve(rows, id_col, parent_col, replies_col, with_path=True)


def paths(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", replies_col: str | None = None) -> DataFrame:
    """(id, root_id, node_depth, path): path is written out, joined by ``/``, for reading."""
    return chains(rows, id_col, parent_col, replies_col).withColumn("path", F.array_join("path", "/"))


def loops(resolved: DataFrame) -> DataFrame:
    """(loop_id, id): the nodes on or below each loop, which is named by its smallest id."""
    return resolved.where("node_depth = -1").select(F.col("root_id").alias("loop_id"), "id")


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, id, distance): every node below every node, from the paths of :func:`chains`; loops have none."""
    up = resolved.where("path IS NOT NULL AND node_depth > 0").select("id", F.posexplode("path").alias("pos", "ancestor"), "node_depth")
    return up.where("pos < node_depth").select("ancestor", "id", (F.col("node_depth") - F.col("pos")).cast("int").alias("distance"))
