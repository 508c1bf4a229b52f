"""Every query of the package runs over the smallest tables; samples bound what the driver sees."""

import os
from pathlib import Path

import pytest

from gleaner.llm import catalog
from gleaner.llm.common import sample_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {"p2_found": "cluster_id id", "p3_found": "table_name rec_id line_no", "p4_found": "table_name rec_id", "p5_found": "id_a id_b", "p6_found": "id field_name", "p7_found": "field_name id_a id_b", "p9_found": "doc_id eval_id", "p10_found": "doc_id"}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
        assert len(rows) == len(set(rows))


def test_sample_rows(spark):
    d = spark.range(1000).selectExpr("cast(id as string) as k")
    a, b = sample_rows(d, "k", 20), sample_rows(d.repartition(7), "k", 20)
    assert len(a) == 20 and a == b and sample_rows(d.limit(0), "k", 5) == []
