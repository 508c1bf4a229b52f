"""Queries of the hierarchy operator over the comments table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators import hierarchy


def _comments(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/comments.parquet").select("id", "parent_id", "replies")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.resolve(_comments(spark, sf), replies_col="replies")


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.paths(_comments(spark, sf), replies_col="replies")


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.chains(_comments(spark, sf), replies_col="replies"))


def p1_loops(spark: SparkSession, sf: str) -> DataFrame:
    """The links that close on themselves: each loop with the nodes on and below it."""
    return hierarchy.loops(hierarchy.resolve(_comments(spark, sf), replies_col="replies"))


QUERIES = {"p1_loops": p1_loops, "p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants}

_LINKS = r"""
WITH RECURSIVE rws AS (
  SELECT id, regexp_replace(regexp_replace(parent_id, '\s+', '', 'g'), '^[^#]*#(comment-)?', '') AS ref, replies FROM comments WHERE id IS NOT NULL),
own AS (SELECT id, min(r.ref) FILTER (WHERE r.ref IN (SELECT id FROM rws)) AS parent, count(*) FILTER (WHERE r.ref IS NOT NULL AND r.ref NOT IN ('', '0')) AS n FROM rws r GROUP BY id),
lst AS (SELECT child AS id, min(p) AS parent FROM (SELECT id AS p, unnest(replies) AS child FROM rws) GROUP BY child),
lnk AS (SELECT o.id, CASE WHEN o.n > 0 THEN o.parent ELSE l.parent END AS parent FROM own o LEFT JOIN lst l ON o.id = l.id),
tree AS (
  SELECT id, id AS root_id, 0 AS node_depth, id AS path FROM lnk WHERE parent IS NULL
  UNION ALL
  SELECT k.id, t.root_id, t.node_depth + 1, t.path || '/' || k.id FROM tree t JOIN lnk k ON k.parent = t.id),
opn AS (SELECT * FROM lnk WHERE id NOT IN (SELECT id FROM tree)),
rch AS (SELECT id AS a, parent AS b FROM opn UNION SELECT r.a, o.parent FROM rch r JOIN opn o ON o.id = r.b),
ring AS (SELECT a AS id FROM rch WHERE a = b),
lps AS (SELECT r.a AS id, min(r.b) AS root_id FROM rch r WHERE r.b IN (SELECT id FROM ring) GROUP BY r.a),
res AS (SELECT * FROM tree UNION ALL SELECT id, root_id, -1, NULL FROM lps)
"""
ORACLES = {
    "p1_loops": _LINKS + "SELECT root_id AS loop_id, id FROM lps",
    "p1_found": _LINKS + "SELECT id, root_id, CAST(node_depth AS INT) AS node_depth FROM res",
    "p1_paths": _LINKS + "SELECT id, root_id, CAST(node_depth AS INT) AS node_depth, path FROM res",
    "p1_descendants": _LINKS
    + """, ups AS (SELECT id, node_depth, unnest(string_split(path, '/')) AS ancestor, unnest(range(0, node_depth + 1)) AS pos FROM tree)
SELECT ancestor, id, CAST(node_depth - pos AS INT) AS distance FROM ups WHERE pos < node_depth""",
}
