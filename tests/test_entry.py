import os

import pytest

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p4_found", "p6_found"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "vec_id", "sim", "rank"]
    assert entry.queries()["p6_found"](spark, "/root/testdata/sf0.001").count() > 0
