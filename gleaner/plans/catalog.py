"""All core queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ("hierarchy_queries", "text_queries", "relational_queries", "corpus_queries", "stream_queries", "claims_queries", "stories_queries", "rounds_queries", "parse_queries", "source_queries")


def gather(package: str, modules: tuple[str, ...]) -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for m in modules:
        mod = import_module(f"{package}.{m}")
        queries |= mod.QUERIES
        sql |= mod.ORACLES
    return queries, sql


QUERIES, ORACLES = gather("gleaner.plans", MODULES)
