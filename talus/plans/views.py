"""Incident views of the supplied tables, for Spark and for the oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.datetime(2001, 8, 2)

TITLES = [
    "Troops rescue hostages in Zamfara", "Bandits kill villagers in Katsina", "Police arrest gunmen near Jos", "Troops foil attack; soldiers killed",
    "Troops neutralize 16 terrorists", "ISWAP kills troops in Borno", "Soldiers killed in ambush", "Vigilance group killed 10 bandits",
    "Army freed 5 abducted", "Gunmen storm market in Plateau State", "Air force eliminated 40 insurgents", "Farmers attacked in Benue, Nigeria",
]
DESCRIPTIONS = [
    "On March 3, 2026 the army said that terrorists were neutralized.", "Several residents were killed and others abducted on 7 May 2026.",
    "Since 5 April 2026 soldiers rescued 12 kidnapped women.", "The military eliminated fighters in the forest; no civilian was hurt.",
    "Operation Hadin Kai recovered arms.", "Villagers said March 3 or 4, 2026 was the day.", "On February 30, 2026 gunmen raided the town.",
    "Nothing more is known.", "Police arrested three kidnappers.", "A farmer was injured in March 3 2014.",
]
STATES_SEEN = ["Borno State", "abuja", "Borno/Yobe", "Borno and Yobe", "cross_river", "nassarawa", "", "new place", "KANO", " Oyo ", "Akwa-Ibom", "Federal Capital Territory", "yobe; Borno", "rivers state", "Sandstorm"]
URLS_SEEN = [
    "https://www.punchng.com/news/attack-in-jos/", "https://x.ng/", "https://x.ng/ab", "ftp://x/abc", "https://x.ng/a.png", "https://www.google.com/search?q=1", "nope",
    " HTTPS://A.B/c/ ", "https://news.bbc.co.uk/2026/04/09/story", "https://vertexaisearch.cloud.google.com/grounding/abc", "https://a.b/2026-13-40/x", "http://news.dailytrust.com/story.html", "https://youtube.com/watch", "https://a.b/story.mp3",
]
PUBLISHERS_SEEN = ["Punch", "Unknown", "", "Daily Trust", "Al Jazeera English", "Trust TV", "Local blog", "YouTube", "Reuters"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def sql_pick(values: list[str], i: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({i}) % {len(values)} + 1]"


def _count(k: Column, null_every: int, n: int) -> Column:
    return F.when(k % null_every != 0, k % n).cast("int")


def incidents(spark: SparkSession, sf_dir: str, sources: bool = False) -> DataFrame:
    """Flat incidents of orders, with their sources from line items where asked for."""
    orders, customer, nation = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    placed = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"])
    out = placed.select(
        k.alias("_id"), F.concat_ws(" ", pick(TITLES, k), F.lit("near"), "c_name").alias("title"), pick(DESCRIPTIONS, k).alias("description"),
        F.col("o_orderdate").cast("timestamp").alias("date"), F.col("n_name").alias("state"), F.when(k % 9 == 0, "Unknown").otherwise(F.col("c_mktsegment")).alias("lga"),
        F.when(k % 8 == 0, "Unknown").otherwise(F.col("c_name")).alias("town"), F.col("o_orderpriority").alias("group"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "unconfirmed").otherwise("developing").alias("status"),
        _count(k, 7, 60).alias("killed"), _count(k, 5, 40).alias("injured"), _count(k, 3, 120).alias("kidnapped"), _count(k, 11, 30).alias("displaced"),
        F.when(k % 17 == 0, True).when(k % 2 == 0, None).otherwise(False).alias("_deleted"),
        (F.col("o_orderdate").cast("timestamp") + F.make_interval(days=(k % 6).cast("int"))).alias("createdAt"),
    )
    if not sources:
        return out
    s = source_rows(spark, sf_dir).groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("url", "title", "publisher").alias("s")))).alias("l"))
    return out.join(s.select("_id", F.transform("l", lambda x: x["s"]).alias("sources")), "_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<url:string,title:string,publisher:string>>")))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(_id, pos, url, title, publisher) of line items."""
    item, supplier = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "supplier")
    url = F.concat(F.lit("https://news"), (F.col("l_suppkey") % 5).cast("string"), F.lit(".example.com/Story/"), (F.col("l_partkey") % 1000).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "/").otherwise(""))
    return item.join(supplier, item["l_suppkey"] == supplier["s_suppkey"]).select(F.col("l_orderkey").alias("_id"), F.col("l_linenumber").cast("int").alias("pos"), url.alias("url"), F.col("l_returnflag").alias("title"), F.col("s_name").alias("publisher"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases over events: (event_id, title, description, state_raw, url, publisher, counts)."""
    k = F.col("event_id")
    return load(spark, sf_dir, "events").select(
        k, F.col("ts").cast("timestamp").alias("ts"), pick(TITLES, k).alias("title"), pick(DESCRIPTIONS, F.floor(k / 12)).alias("description"), pick(STATES_SEEN, k).alias("state_raw"),
        pick(STATES_SEEN, F.floor(k / 15)).alias("state_other"), pick(URLS_SEEN, k).alias("url"), pick(PUBLISHERS_SEEN, F.floor(k / 14)).alias("publisher"),
        _count(k, 7, 20).alias("killed"), _count(k, 5, 3).alias("injured"), _count(k, 3, 2).alias("kidnapped"), F.lit(None).cast("int").alias("displaced"),
    )


def titled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its first 80 characters as a title, in which those beyond ASCII are question marks (engines count edits of them differently); a null text is empty."""
    docs = load(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.regexp_replace(F.substring("text", 1, 80), r"[^\x00-\x7f]", "?").alias("title"), "text", "source")


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its first 80 characters as they are. Columns as in titled_documents."""
    docs = load(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.substring("text", 1, 80).alias("title"), "text", "source")


def _sql_count(k: str, null_every: int, n: int) -> str:
    return f"CASE WHEN {k} % {null_every} <> 0 THEN {k} % {n} END"


INC = f"""inc AS (SELECT o_orderkey AS _id, {sql_pick(TITLES, "o_orderkey")} || ' near ' || c_name AS title, {sql_pick(DESCRIPTIONS, "o_orderkey")} AS description,
o_orderdate AS date, n_name AS state, CASE WHEN o_orderkey % 9 = 0 THEN 'Unknown' ELSE c_mktsegment END AS lga, CASE WHEN o_orderkey % 8 = 0 THEN 'Unknown' ELSE c_name END AS town,
o_orderpriority AS "group", CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'unconfirmed' ELSE 'developing' END AS status,
{_sql_count("o_orderkey", 7, 60)} AS killed, {_sql_count("o_orderkey", 5, 40)} AS injured, {_sql_count("o_orderkey", 3, 120)} AS kidnapped, {_sql_count("o_orderkey", 11, 30)} AS displaced,
CASE WHEN o_orderkey % 17 = 0 THEN true WHEN o_orderkey % 2 = 0 THEN NULL ELSE false END AS _deleted, o_orderdate + to_days((o_orderkey % 6)::int) AS createdAt
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), act AS (SELECT * FROM inc WHERE NOT coalesce(_deleted, false))"""
SRC = """src AS (SELECT l_orderkey AS _id, l_linenumber AS pos, 'https://news' || (l_suppkey % 5) || '.example.com/Story/' || (l_partkey % 1000) || CASE WHEN l_linenumber % 2 = 0 THEN '/' ELSE '' END AS url,
l_returnflag AS title, s_name AS publisher FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
REP = f"""rep AS (SELECT event_id, ts, {sql_pick(TITLES, "event_id")} AS title, {sql_pick(DESCRIPTIONS, "event_id // 12")} AS description, {sql_pick(STATES_SEEN, "event_id")} AS state_raw,
{sql_pick(STATES_SEEN, "event_id // 15")} AS state_other, {sql_pick(URLS_SEEN, "event_id")} AS url, {sql_pick(PUBLISHERS_SEEN, "event_id // 14")} AS publisher,
{_sql_count("event_id", 7, 20)} AS killed, {_sql_count("event_id", 5, 3)} AS injured, {_sql_count("event_id", 3, 2)} AS kidnapped, 0 AS displaced FROM events)"""
DOC = """doc AS (SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 80), '[^\\x00-\\x7f]', '?', 'g') AS title, coalesce(text, '') AS text, source FROM documents)"""
