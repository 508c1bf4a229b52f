"""Every core query against its SQL on the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import pytest

from gleaner.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    from tools.oracle import norm

    df = catalog.QUERIES[name](spark, SF)
    got = Counter(repr(tuple(norm(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name in catalog.ORACLES:
        rel = db.sql(catalog.ORACLES[name])
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert sorted(rel.columns) == sorted(df.columns)
        assert got == Counter(repr(tuple(norm(r[i]) for i in order)) for r in rel.fetchall())
