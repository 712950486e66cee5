"""Dashboard aggregates. Each takes the flat incidents and a fixed `as_of`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import normalize_state
from ..schema import active


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0))


def this_year(flat: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Active rows from the year's first moment on; there is no upper bound."""
    return flat.where(active() & (F.col("date") >= F.lit(dt.datetime(as_of.year, 1, 1))))


def overview(flat: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One pass for year, 30 days and 7 days."""
    year = F.col("date") >= F.lit(dt.datetime(as_of.year, 1, 1))

    def since(days: int) -> Column:
        return F.col("date") >= F.lit(as_of - dt.timedelta(days=days))

    def in_year(c: str) -> Column:
        return F.coalesce(F.sum(F.when(year, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).alias(f"total_{c}")

    earliest = min(dt.datetime(as_of.year, 1, 1), as_of - dt.timedelta(days=30))
    rows = flat.where(active() & (F.col("date") >= F.lit(earliest)))
    return rows.agg(F.count_if(year).alias("total_incidents"), *[in_year(c) for c in ("killed", "injured", "kidnapped")], F.count_if(since(30)).alias("last_30_days"), F.count_if(since(7)).alias("last_7_days"))


def by_state(flat: DataFrame, as_of: dt.datetime, most: int = 10) -> DataFrame:
    return this_year(flat, as_of).groupBy("state").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "state").limit(most)


def by_group(flat: DataFrame, as_of: dt.datetime, most: int = 10) -> DataFrame:
    return this_year(flat, as_of).groupBy("group").agg(F.count("*").alias("cnt"), _sum("killed").alias("killed")).orderBy(F.desc("cnt"), "group").limit(most)


def by_month(flat: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Months 1 to that of as_of, those without rows as zeros."""
    sums = this_year(flat, as_of).groupBy(F.month("date").cast("long").alias("month")).agg(F.count("*").alias("incidents"), _sum("killed").alias("killed"), _sum("kidnapped").alias("kidnapped"))
    months = flat.sparkSession.range(1, as_of.month + 1).withColumnRenamed("id", "month")
    return months.join(sums, "month", "left").na.fill(0)


def by_year_month(flat: DataFrame) -> DataFrame:
    return flat.where(active()).groupBy(F.date_format("date", "yyyy-MM").alias("ym")).agg(F.count("*").alias("incidents"), _sum("killed").alias("killed"), _sum("kidnapped").alias("kidnapped"))


def month_samples(flat: DataFrame, most: int = 3) -> DataFrame:
    """Per month: counts, and the ids of its first rows."""
    ym = F.date_format("date", "yyyy-MM")
    numbered = flat.where(active()).withColumn("ym", ym).withColumn("rn", F.row_number().over(W.partitionBy("ym").orderBy("date", "_id")))
    sums = flat.where(active()).groupBy(ym.alias("ym")).agg(F.count("*").alias("incidents"), _sum("killed").alias("killed"))
    firsts = numbered.where(F.col("rn") <= most).groupBy("ym").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("rn", "_id"))), lambda x: x["_id"].cast("string"))).alias("samples"))
    return sums.join(firsts, "ym")


def publishers(flat: DataFrame) -> DataFrame:
    named = flat.where(active()).select(F.explode("sources").alias("s")).select(F.col("s.publisher").alias("publisher"))
    return named.where("publisher IS NOT NULL AND publisher <> ''").distinct().orderBy("publisher")


def state_dim(spark: SparkSession) -> DataFrame:
    """The 37 states with their region."""
    return spark.createDataFrame([(s, r) for r, states in V.REGIONS.items() for s in states], "state string, region string")


def map_by_state(flat: DataFrame, names: DataFrame, newest: int | None = 1000) -> DataFrame:
    """Each state of `names` (state) with what the newest rows count there, intensity and look; states without rows have zeros."""
    rows = flat.where(active()).orderBy(F.desc("date"), "_id")
    rows = rows.limit(newest) if newest else rows
    sums = rows.groupBy(F.lower(normalize_state("state")).alias("key")).agg(F.count("*").alias("cnt"), *[_sum(c).alias(c) for c in ("killed", "injured", "kidnapped")])
    # At most `newest` rows are counted, so the sums are a small table.
    filled = names.select("state", F.lower("state").alias("key")).join(F.broadcast(sums) if newest else sums, "key", "left").na.fill(0, ["cnt", "killed", "injured", "kidnapped"]).drop("key")
    top = filled.agg(F.greatest(F.lit(1), F.max("cnt")).alias("top"))
    i = F.col("cnt") / F.col("top")
    shown = filled.crossJoin(F.broadcast(top)).withColumn("intensity", i)
    return shown.withColumns({"bucket": intensity_bucket(F.col("intensity")), "radius": dot_radius(F.col("intensity")), "opacity": fill_opacity(F.col("intensity"))}).drop("top")


def intensity_bucket(i: Column) -> Column:
    return F.when(i == 0, "muted").when(i > 0.7, "urgent").when(i > 0.4, "ember").when(i > 0.15, "caution").otherwise("safe")


def dot_radius(i: Column) -> Column:
    return F.when(i == 0, F.lit(4.0)).otherwise(6 + 14 * i)


def fill_opacity(i: Column) -> Column:
    return F.when(i == 0, F.lit(0.2)).otherwise(0.3 + 0.5 * i)


def recent(flat: DataFrame, most: int = 5, by: str = "date") -> DataFrame:
    """The newest active rows by `date` or `createdAt`."""
    return flat.where(active()).orderBy(F.desc(by), "_id").limit(most)


def state_page(flat: DataFrame, page: int, size: int = 5) -> DataFrame:
    """(state, _id): the page of each state's active rows, newest first."""
    rn = F.row_number().over(W.partitionBy("state").orderBy(F.desc("date"), "_id"))
    return flat.where(active()).select("state", "_id", rn.alias("rn")).where(F.col("rn").between((page - 1) * size + 1, page * size)).drop("rn")


def ranked_states(flat: DataFrame) -> DataFrame:
    """(state, cnt, rank, share): states by their active rows, share as a part of the most in percent; one row for each state is ranked."""
    sums = flat.where(active()).groupBy("state").agg(F.count("*").alias("cnt"))
    return sums.select("state", "cnt", F.row_number().over(W.orderBy(F.desc("cnt"), "state")).alias("rank"), (F.col("cnt") * 100.0 / F.max("cnt").over(W.partitionBy())).alias("share"))


def ingest_counters(actions: DataFrame) -> DataFrame:
    """Saved, merged and failed rows of (region, action), and a total row."""
    sums = [F.count_if(F.col("action") == a).alias(n) for a, n in (("saved", "saved"), ("merged", "merged"), ("error", "errors"))]
    return actions.rollup("region").agg(F.grouping("region").alias("g"), *sums).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("region")).alias("region"), "saved", "merged", "errors")
