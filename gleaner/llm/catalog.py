"""All queries of this package, gathered from its query module."""

from __future__ import annotations

from gleaner.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
