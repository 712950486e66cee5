"""Files in and out: extended-JSON exports, landing zones, reports."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import json_array, lenient_json_array
from ..schema import INCIDENT_DDL

RAW_DDL = """title STRING, description STRING, date STRING, location STRUCT<state:STRING,lga:STRING,town:STRING>, `group` STRING,
casualties STRUCT<killed:INT,injured:INT,kidnapped:INT,displaced:INT>, sources ARRAY<STRUCT<url:STRING,title:STRING,publisher:STRING>>,
civilianCasualties BOOLEAN, status STRING, tags ARRAY<STRING>"""

_EXPORT_DDL = (
    INCIDENT_DDL.replace("_id STRING", "_id STRUCT<`$oid`:STRING>", 1)
    .replace("date TIMESTAMP", "date STRUCT<`$date`:STRING>")
    .replace("createdAt TIMESTAMP", "createdAt STRUCT<`$date`:STRING>")
    .replace("updatedAt TIMESTAMP", "updatedAt STRUCT<`$date`:STRING>")
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a temporary one if the master is local, else ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back, for what several later steps read: lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Incidents of a JSON export, its $oid and $date wrappers taken off."""
    df = spark.read.schema(_EXPORT_DDL).json(path, multiLine=True)
    when = lambda c: F.try_to_timestamp(F.col(f"{c}.`$date`")).alias(c)
    return df.select(*[F.col("_id.`$oid`").alias("_id") if c == "_id" else when(c) if c in ("date", "createdAt", "updatedAt") else F.col(f"`{c}`") for c in df.columns])


def parse_reports(answers: DataFrame, column: str = "text", lenient: bool = False) -> DataFrame:
    """Raw reports in model answers: the JSON array in each, one row for each element; answers without one give none."""
    rows = F.from_json(lenient_json_array(column) if lenient else json_array(column), f"ARRAY<STRUCT<{', '.join(_as_fields(RAW_DDL))}>>")
    return answers.select(F.explode(rows).alias("r")).select("r.*").withColumn("date", F.try_to_timestamp("date"))


def _as_fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[start:i].strip().split(None, 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return out


def read_answers(spark: SparkSession, path: str, states: list[str] | None = None, lenient: bool = True) -> DataFrame:
    """Raw reports in the answers that lie in `path`, one text file each; of the listed states alone, where there is a list."""
    from ..operators.ingest import of_states

    found = parse_reports(spark.read.text(path, wholetext=True), "value", lenient)
    flat = found.select("*", *[F.col(f"location.{c}").alias(c) for c in ("state", "lga", "town")])
    return flat if states is None else of_states(flat, states)


def read_periods(spark: SparkSession, path: str, grid: DataFrame) -> DataFrame:
    """Raw reports of historical scans, in `path`/region=.../first=... as JSON lines, of the regions and windows of grid (first, last, region), inside their window by a day more on both sides."""
    from ..operators.ingest import near_window

    rows = spark.read.schema(f"{RAW_DDL}, region STRING, first DATE").json(path).withColumn("date", F.try_to_timestamp("date"))
    wanted = rows.join(F.broadcast(grid.select("region", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"))), ["region", "first"])
    return wanted.where(near_window(F.col("first").cast("timestamp"), F.col("last").cast("timestamp") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")))


def write_periods(raw: DataFrame, path: str) -> None:
    """Raw reports with the region and first day of the scan that found them, as read_periods() reads them."""
    raw.write.partitionBy("region", "first").json(path)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of raw reports from JSON lines as they land."""
    return spark.readStream.schema(RAW_DDL).json(path)


def resolve_redirects(urls: DataFrame, redirects: DataFrame, column: str = "url") -> DataFrame:
    """urls with addresses replaced by where they lead, from a table (url, final_url)."""
    known = redirects.select(F.col("url").alias("_from"), F.col("final_url").alias("_to")).dropDuplicates(["_from"])
    return urls.join(known, urls[column] == known["_from"], "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def keyset(df: DataFrame, last: str | int | None, size: int = 200, key: str = "_id") -> DataFrame:
    """The next `size` rows by key after `last`."""
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(size)


def as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def as_text(df: DataFrame) -> Column:
    """The columns of a row as lines "name: value"."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))) for c in df.columns])


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """One JSON object for each row, or for "text" its lines, a blank one after each row."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    else:
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])
        flat.select(F.concat(as_text(flat), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
