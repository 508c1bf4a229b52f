"""Lists of terms met by the items that hold them, block by block.

Joining each term of each list with its postings pairs every list that holds a
frequent term with every item that holds it. Here a block of items is turned
into sorted postings once, every list is intersected there from its rarest term
on, and only what a block found leaves it. Lists are repeated once a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 15


class Postings:
    """Of one block: the places (in the order of the ids) of the items that hold a term."""

    def __init__(self, items: pa.Table, lists: pa.Table) -> None:
        items = items.sort_by("id")
        self.ids = items.column("id")
        said = pc.list_flatten(lists.column("terms")).combine_chunks()
        wanted = pc.unique(said)
        held = items.column("terms")
        code = pc.fill_null(pc.index_in(pc.list_flatten(held).combine_chunks(), value_set=wanted), -1).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(items), dtype=np.int32), pc.fill_null(pc.list_value_length(held), 0).to_numpy())
        owner, code = owner[code >= 0], code[code >= 0]
        self._owner = owner[np.argsort(code, kind="stable")]
        self._at = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(wanted)))))
        codes = pc.index_in(said, value_set=wanted).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists.column("terms")), 0).to_numpy())
        self.lists = np.split(codes, ends[:-1]) if len(ends) else []

    def of(self, term: int) -> np.ndarray:
        return self._owner[self._at[term] : self._at[term + 1]]

    def among(self, places: np.ndarray, term: int) -> np.ndarray:
        """Which of some places hold a term."""
        p = self.of(term)
        if not len(p):
            return np.zeros(len(places), dtype=bool)
        return p[np.minimum(np.searchsorted(p, places), len(p) - 1)] == places

    def all_of(self, terms: np.ndarray) -> np.ndarray:
        """The places that hold all of some terms (at least one), in order."""
        size = self._at[terms + 1] - self._at[terms]
        order = terms[np.argsort(size, kind="stable")]
        got = self.of(order[0])
        for t in order[1:]:
            if not len(got):
                break
            got = got[self.among(got, t)]
        return got


def per_block(items: DataFrame, n: int, lists: DataFrame, find: Callable[[Postings, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``find`` makes of each block; items: (id, terms), about ``n`` of them with unique ids, terms once each; lists: a table with ``terms``."""
    blocks = n // BLOCK + 1
    a = items.where("size(terms) > 0").withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    b = lists.where("size(terms) > 0").withColumn("blk", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return find(Postings(right, left), left)

    # numbers of partitions that AQE keeps: a block fills a task, and few should share one
    return b.repartition(3 * blocks, "blk").groupBy("blk").cogroup(a.repartition(3 * blocks, "blk").groupBy("blk")).applyInArrow(run, schema)
