"""Expressions that are dear are worked out once a row, and by all tasks."""

import os

import pytest
from pyspark.sql import functions as F

from talus import catalog
from talus.functions import text, urls

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_stand_once(spark):
    rows = spark.range(1).select(F.col("id").cast("string").alias("c"))
    assert plan(rows.select(text.normalize_state("c").alias("s"))).count("regexp_replace") <= 8
    relevant = urls.source_relevant(F.array("c"), F.array("c"), "c", "c")
    assert plan(rows.select(relevant.alias("s"))).count("split(") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["source_relevant", "join_chunk_rank", "join_gap_chunks", "normalized_reports"])
def test_reports_of_one_file_are_dealt_out(spark, name):
    assert "RepartitionByExpression" in plan(catalog.QUERIES[name](spark, SF))
