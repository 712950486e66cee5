"""Tables that grow are not broadcast: the driver would hold them whole."""

import os

import pytest

from talus import catalog
from talus.operators import dedup, repair

from .test_operators import flat, row

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
@pytest.mark.parametrize("name", ["join_gap_chunks"])
def test_nothing_is_broadcast(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made", [lambda rows, pairs: repair.merged_away(rows, pairs, "Duplicate of "), lambda rows, pairs: dedup.exact_clusters(rows)])
def test_repairs_broadcast_nothing(spark, made):
    """Merges and clusters meet their rows by merges, however small what is merged lies in files."""
    df = made(flat(spark, row(1, title="A"), row(2, title="A"), row(3, title="B")), spark.createDataFrame([(1, 2)], "kept int, dropped int"))
    assert len(df.collect()) >= 2
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
