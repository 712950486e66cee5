"""Batch repairs: curated merges, date fixes, source checks and recovery, scan grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.dates import date_fix, narrative_date
from ..functions.text import normalize_state, text
from ..functions.urls import invalid_reason
from ..schema import active
from ..sources.files import settled
from .dedup import cross_state_merges, exact_clusters
from .ingest import apply, complete, with_civilians, with_hash
from .merge import merged_in_place, soft_delete, undelete


def flag_groups(flat: DataFrame, groups: DataFrame, reason: str = "Duplicate") -> DataFrame:
    """flat with curated pairs (kept, dropped) merged, the dropped rows soft-deleted, and every state in canonical form."""
    out = merged_in_place(flat, groups, tags="tags" in flat.columns)
    # Distinct ids, so that what is joined to the rows for other columns is not made for them.
    known = groups.join(flat.select(F.col("_id").alias("kept")).distinct(), "kept", "left_semi")
    return _canonical(soft_delete(out, known.select(F.col("dropped").alias("_id")), reason), flat)


def _canonical(rows: DataFrame, flat: DataFrame) -> DataFrame:
    """rows with states in canonical form: each distinct one of flat, whose states they have, is told once."""
    seen = flat.select(text("state").alias("_seen")).distinct()
    named = settled(seen.withColumn("_named", normalize_state("_seen")), "states")
    return rows.join(named, text("state") == F.col("_seen"), "left").withColumn("state", F.col("_named")).select(rows.columns)


def repair_quality(flat: DataFrame, first: Column, last: Column) -> tuple[DataFrame, DataFrame]:
    """(flat repaired, what was done) for active rows from `first` to before `last`: exact clusters merged, then cross-state pairs, then dates that the narrative corrects.

    What was done is (step, _id, kept, date): the row that was merged away and into which one, or the date that it got. Of a cross-
    state pair the row with more sources, then the longer description, then the smaller _id stays. A row that is merged away more
    than once goes into its smallest partner, and none goes into a row that has itself gone.
    """
    in_time = (F.col("date") >= first) & (F.col("date") < last)
    clusters = exact_clusters(flat.where(in_time))
    exact = settled(clusters.where("rank = 1").select("cluster", F.col("_id").alias("kept")).join(clusters.where("rank > 1").select("cluster", F.col("_id").alias("dropped")).hint("merge"), "cluster").select("kept", "dropped"), "exact-duplicates")
    out = settled(merged_away(flat, exact, "Exact duplicate of "), "without-exact")
    now = out.where(in_time)
    weight = F.struct(F.size(F.coalesce("sources", F.array())).alias("n"), F.length(text("description")).alias("l"), (-F.col("_id")).alias("i"))
    cross = settled(cross_state_merges(now, weight), "cross-state")
    out = settled(merged_away(out, cross, "Cross-state duplicate of "), "without-cross-state")
    fixes = date_fixes(out.where(in_time)).select("_id", "fixed")
    dated = out.join(fixes.hint("merge"), "_id", "left").withColumn("date", F.coalesce("fixed", "date")).select(flat.columns)
    done = exact.select(F.lit("exact").alias("step"), F.col("dropped").alias("_id"), "kept", F.lit(None).cast("timestamp").alias("date"))
    done = done.unionByName(cross.select(F.lit("cross-state").alias("step"), F.col("dropped").alias("_id"), "kept", F.lit(None).cast("timestamp").alias("date")))
    return dated, done.unionByName(fixes.select(F.lit("date").alias("step"), "_id", F.lit(None).cast(flat.schema["_id"].dataType).alias("kept"), F.col("fixed").alias("date")))


def merged_away(flat: DataFrame, pairs: DataFrame, reason: str) -> DataFrame:
    """flat with pairs (kept, dropped) merged and the dropped rows soft-deleted, their reason naming the kept one."""
    out = merged_in_place(flat, pairs)
    gone = out.join(pairs.select(F.col("dropped").alias("_id"), F.col("kept").alias("_kept")).dropDuplicates(["_id"]).hint("merge"), "_id", "left")
    out = gone.withColumn("_deleted", F.when(F.col("_kept").isNotNull(), True).otherwise(F.coalesce("_deleted", F.lit(False))))
    if "_deletedReason" in flat.columns:
        out = out.withColumn("_deletedReason", F.when(F.col("_kept").isNotNull(), F.concat(F.lit(reason), F.col("_kept").cast("string"))).otherwise(F.col("_deletedReason")))
    return out.select(flat.columns)


def state_fixes(flat: DataFrame) -> DataFrame:
    """(_id, old, new) of states that are not in canonical form."""
    return flat.select("_id", F.col("state").alias("old"), normalize_state("state").alias("new")).where("old <> new")


def date_fixes(flat: DataFrame) -> DataFrame:
    """(_id, date, fixed) where the narrative tells another month, 7 to 60 days away."""
    return flat.where(active()).select("_id", "date", date_fix(F.col("date"), narrative_date("description")).alias("fixed")).where("fixed IS NOT NULL")


def source_checks(flat: DataFrame) -> DataFrame:
    """(_id, url, reason) of every source; reason is null for valid ones. Each distinct address is judged once."""
    each = flat.where(active()).select("_id", F.explode("sources").alias("s")).select("_id", F.col("s.url").alias("url"))
    judged = each.select(F.col("url").alias("_url")).distinct().withColumn("reason", invalid_reason("_url"))
    return each.join(judged, F.col("url").eqNullSafe(F.col("_url")), "left").drop("_url")


def fix_sources(flat: DataFrame, replacements: DataFrame | None = None) -> DataFrame:
    """(_id, action, sources): keep, prune (some invalid), replace (none valid, found ones in `replacements` (_id, sources)), or delete."""
    valid = F.filter(F.coalesce("sources", F.array()), lambda s: invalid_reason(s["url"]).isNull())
    rows = flat.where(active()).select("_id", F.coalesce("sources", F.array()).alias("old"), valid.alias("valid"))
    if replacements is not None:
        rows = rows.join(replacements.select("_id", F.col("sources").alias("found")), "_id", "left")
    else:
        rows = rows.withColumn("found", F.lit(None).cast(flat.schema["sources"].dataType))
    whole = (F.size("old") > 0) & (F.size("valid") == F.size("old"))
    action = F.when(whole, "keep").when(F.size("valid") > 0, "prune").when(F.size(F.coalesce("found", F.array())) > 0, "replace").otherwise("delete")
    return rows.select("_id", action.alias("action"), F.when(action == "replace", F.slice("found", 1, 3)).otherwise(F.col("valid")).alias("sources"))


def counters(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count("*").alias("scanned"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("prune", "pruned"), ("replace", "replaced"), ("delete", "deleted"))])


def recover(flat: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """Rows soft-deleted for want of sources come back with those found (_id, sources), three at most."""
    lost = flat.where(~active() & F.lower(text("_deletedReason")).contains("no replacements found")).select("_id")
    usable = found.where(F.size("sources") > 0).join(lost, "_id", "left_semi")
    out = undelete(flat, usable).join(usable.select("_id", F.slice("sources", 1, most).alias("_found")), "_id", "left")
    return out.withColumn("sources", F.coalesce("_found", "sources")).select(flat.columns)


def backfill(stored: DataFrame, windows: list[DataFrame], now: Column) -> DataFrame:
    """stored after raw reports of several windows, one after the other: each window's are matched with what the earlier ones left.

    Reports that say that no civilian was harmed, or lack a required field, are left out.
    """
    out = with_hash(stored)
    for raw in windows:
        ready = with_civilians(raw) if "civilianCasualties" in raw.columns else raw
        out = settled(apply(ready.where(complete(ready)), out, now), "backfill")
    return out


def first_matching(rows: DataFrame, predicate: Column, *order: str | Column) -> DataFrame:
    """The first row in `order` that meets the predicate, or the first of all if none does."""
    return rows.withColumn("_no", ~F.coalesce(predicate, F.lit(False))).orderBy("_no", *order).limit(1).drop("_no")


def scan_grid(spark: SparkSession, windows: list[Column]) -> DataFrame:
    """(first, last, region): every window for every region; both are small fixed lists."""
    regions = spark.createDataFrame([(r,) for r in V.REGIONS], "region string")
    spans = spark.range(1).select(F.explode(F.flatten(F.array(*windows))).alias("w")).select("w.first", "w.last")
    return spans.join(regions, how="cross")
