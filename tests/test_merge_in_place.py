"""Curated merges beside the rows they are merged into: the same rows as merging apart, and the rows are made no oftener than need be."""

from pyspark.sql import functions as F
from talus.functions.text import normalize_state
from talus.operators import merge, repair
from tests.test_operators import flat, row


def some(spark):
    return flat(
        spark, row(1, killed=3, urls=["https://a.b/one/", "https://a.b/two"]), row(2, killed=5, state="borno state", urls=["HTTPS://A.B/ONE", "https://a.b/three", ""]), row(3, injured=1, status="confirmed", urls=["https://a.b/two/"], state=None),
        row(4, status=None, state=""), row(5, killed=7, deleted=True, state="abuja"), row(6, urls=["https://a.b/six", "https://a.b/six/"], state="new place"), row(7, state="Borno/Yobe", kidnapped=4),
    )


def test_in_place_is_apart(spark):
    """Chains, several into one, a row in two groups, kept and dropped ones that are not there, and rows in no pair, whose own equal addresses stay."""
    rows, pairs = some(spark), spark.createDataFrame([(1, 2), (1, 3), (2, 4), (5, 4), (3, 99), (98, 7), (4, 1)], "kept int, dropped int")
    own = lambda df: sorted(map(str, df.collect()))
    apart = merge.upsert(rows, merge.merge_pairs(rows, pairs))
    assert own(merge.merged_in_place(rows, pairs)) == own(apart)
    want = merge.soft_delete(apart, spark.createDataFrame([(2,), (3,), (4,), (99,), (1,)], "_id int"), "Duplicate").withColumn("state", normalize_state("state"))
    assert own(repair.flag_groups(rows, pairs)) == own(want)


def test_sources_are_made_twice_at_most(spark, tmp_path):
    """Once for the rows, once for what they take in."""
    some(spark).write.parquet(f"{tmp_path}/rows")
    pairs = spark.createDataFrame([(1, 2)], "kept int, dropped int")
    plan = repair.flag_groups(spark.read.parquet(f"{tmp_path}/rows"), pairs)._jdf.queryExecution().sparkPlan().toString()
    assert 1 <= sum("FileScan" in line and "sources#" in line for line in plan.splitlines()) <= 2
