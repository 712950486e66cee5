"""Merging of records: counts, sources, tags, texts and status; soft and hard deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..schema import CASUALTIES


def merge_count(a: Column, b: Column, null_policy: str = "keep") -> Column:
    """The larger count. Of unknowns: "keep" leaves null, "zero" gives 0, "blank" makes 0 null."""
    most = F.greatest(a, b)
    return {"keep": most, "zero": F.coalesce(most, F.lit(0)), "blank": F.nullif(most, F.lit(0))}[null_policy]


def merge_sources(a: Column, b: Column) -> Column:
    """Both lists, the first of equal normalised addresses, in order; those without an address go.

    Each address is normalised once; equal ones are next to each other after a sort by address and place, and the first of each stay.
    """
    both = F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))
    keyed = F.array_sort(F.transform(both, lambda s, i: F.struct(normalize_url(s["url"]).alias("k"), i.alias("i"), s.alias("s"))), _by_key)
    pairs = F.arrays_zip(keyed.alias("x"), F.concat(F.array(F.lit("")), F.transform(keyed, lambda x: x["k"])).alias("before"))
    first = F.filter(pairs, lambda p: p["x"].isNotNull() & (p["x"]["k"] != p["before"]))
    return F.transform(F.array_sort(F.transform(first, lambda p: F.struct(p["x"]["i"].alias("i"), p["x"]["s"].alias("s"))), lambda x, y: x["i"] - y["i"]), lambda x: x["s"])


def _by_key(x: Column, y: Column) -> Column:
    return F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(x["i"] - y["i"])


def new_sources(own: Column, other: Column) -> Column:
    """Those of `other` whose normalised address `own` lacks."""
    known = F.transform(F.coalesce(own, F.array()), lambda s: normalize_url(s["url"]))
    return F.filter(F.coalesce(other, F.array()), lambda s: (normalize_url(s["url"]) != "") & ~F.array_contains(known, normalize_url(s["url"])))


def merge_tags(a: Column, b: Column) -> Column:
    return F.filter(F.array_union(F.coalesce(a, F.array()), F.coalesce(b, F.array())), lambda t: t != "")


def merge_status(existing: Column, candidate: Column) -> Column:
    return F.when(candidate == "confirmed", "confirmed").otherwise(existing)


#: A merged description counts if it has more characters than this.
DESCRIPTION_CHARS = 50


def _folded(flat: DataFrame, pairs: DataFrame, tags: bool) -> DataFrame:
    """What all the dropped rows of each kept one bring along: (_id, m_...), of those that flat has."""
    b = flat.select(F.col("_id").alias("dropped"), *CASUALTIES, "sources", "status", *(["tags"] if tags else []))
    return b.join(pairs.select("kept", "dropped").hint("merge"), "dropped").groupBy(F.col("kept").alias("_id")).agg(
        F.count("*").alias("m_rows"),
        *[F.max(c).alias(f"m_{c}") for c in CASUALTIES],
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("dropped").alias("i"), F.col("sources").alias("s")))), lambda x: x["s"])).alias("m_sources"),
        F.max(F.col("status") == "confirmed").alias("m_confirmed"),
        *([F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array())))).alias("m_tags")] if tags else []),
    )


def _taken_in(null_policy: str, tags: bool) -> dict[str, Column]:
    """The columns of rows beside what is folded into them, with it."""
    new = {c: merge_count(F.col(c), F.col(f"m_{c}"), null_policy) for c in CASUALTIES} | {"sources": merge_sources(F.col("sources"), F.col("m_sources")), "status": F.when(F.col("m_confirmed"), "confirmed").otherwise(F.col("status"))}
    return new | ({"tags": merge_tags(F.col("tags"), F.array_sort("m_tags"))} if tags else {})


def merge_pairs(flat: DataFrame, pairs: DataFrame, null_policy: str = "keep", descriptions: DataFrame | None = None, tags: bool = False) -> DataFrame:
    """The kept rows of pairs (kept, dropped), each with all its dropped ones folded in: larger counts, joined sources, a confirmed status, and tags if asked for.

    descriptions (_id, text) are merged texts from outside, such as a model's; a kept row without one of more than
    DESCRIPTION_CHARS characters keeps its own.
    """
    joined = flat.join(_folded(flat, pairs, tags), "_id")
    if descriptions is not None:
        told = descriptions.select(F.col("_id").alias("_told"), F.trim("text").alias("m_text")).where(F.length("m_text") > DESCRIPTION_CHARS).dropDuplicates(["_told"])
        joined = joined.join(told, F.col("_id") == F.col("_told"), "left").withColumn("description", F.coalesce("m_text", "description"))
    return joined.withColumns(_taken_in(null_policy, tags)).select(flat.columns)


def merged_in_place(flat: DataFrame, pairs: DataFrame, tags: bool = False) -> DataFrame:
    """All rows of flat, the kept ones of pairs as in merge_pairs(): as upsert(flat, merge_pairs(flat, pairs)), but rows meet what they take in once."""
    # Merged, not broadcast: what is folded grows with the rows, and lists are far larger in memory than in files.
    joined = flat.join(_folded(flat, pairs, tags).hint("merge"), "_id", "left")
    return joined.withColumns({c: F.when(F.col("m_rows").isNotNull(), new).otherwise(F.col(c)) for c, new in _taken_in("keep", tags).items()}).select(flat.columns)


def add_sources(flat: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of flat that `more` (_id, sources) adds a new source to, with it; all else is left as it is."""
    added = more.groupBy("_id").agg(F.flatten(F.collect_list("sources")).alias("m_sources"))
    joined = flat.join(added, "_id").withColumn("m_sources", new_sources(F.col("sources"), F.col("m_sources"))).where(F.size("m_sources") > 0)
    return joined.withColumn("sources", merge_sources(F.col("sources"), F.col("m_sources"))).select(flat.columns)


def soft_delete(flat: DataFrame, ids: DataFrame, reason: str) -> DataFrame:
    """flat with the rows of ids (_id) marked as deleted."""
    marked = flat.join(ids.select("_id").distinct().withColumn("_gone", F.lit(True)), "_id", "left")
    out = marked.withColumn("_deleted", F.coalesce(F.col("_gone"), F.col("_deleted"), F.lit(False)))
    if "_deletedReason" in flat.columns:
        out = out.withColumn("_deletedReason", F.when(F.col("_gone"), F.lit(reason[:500])).otherwise(F.col("_deletedReason")))
    return out.select(flat.columns)


def undelete(flat: DataFrame, ids: DataFrame) -> DataFrame:
    marked = flat.join(ids.select("_id").distinct().withColumn("_back", F.lit(True)), "_id", "left")
    return marked.withColumn("_deleted", F.when(F.col("_back"), F.lit(False)).otherwise(F.col("_deleted"))).select(flat.columns)


def hard_delete(flat: DataFrame, ids: DataFrame) -> DataFrame:
    return flat.join(ids.select("_id"), "_id", "left_anti").select(flat.columns)


def delete_by_source(flat: DataFrame, publisher: str) -> DataFrame:
    return flat.where(~F.exists(F.coalesce("sources", F.array()), lambda s: F.coalesce(s["publisher"] == publisher, F.lit(False))))


def upsert(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """stored with the rows of `changed` in place of those with their _id, and the new ones."""
    return stored.join(changed.select("_id"), "_id", "left_anti").select(stored.columns).unionByName(changed.select(stored.columns))
