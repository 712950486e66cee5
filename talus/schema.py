"""The incident record: nested for storage, flat for work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INCIDENT_DDL = """_id STRING, title STRING, description STRING, date TIMESTAMP,
location STRUCT<state:STRING,lga:STRING,town:STRING,coordinates:STRUCT<lat:DOUBLE,lng:DOUBLE>>,
`group` STRING, casualties STRUCT<killed:INT,injured:INT,kidnapped:INT,displaced:INT>,
sources ARRAY<STRUCT<url:STRING,title:STRING,publisher:STRING>>,
status STRING, tags ARRAY<STRING>, hash STRING,
_deleted BOOLEAN, _deletedReason STRING, createdAt TIMESTAMP, updatedAt TIMESTAMP"""

STATUSES = ("confirmed", "unconfirmed", "developing")
CASUALTIES = ("killed", "injured", "kidnapped", "displaced")


def active(deleted: str | Column = "_deleted") -> Column:
    """Rows that are not soft-deleted; a missing mark counts as active."""
    return ~F.coalesce(F.col(deleted) if isinstance(deleted, str) else deleted, F.lit(False))


def flatten(incidents: DataFrame) -> DataFrame:
    """The nested record with its location and casualty fields as columns."""
    plain = [c for c in incidents.columns if c not in ("location", "casualties")]
    return incidents.select(*plain, *[F.col(f"location.{c}").alias(c) for c in ("state", "lga", "town", "coordinates")], *[F.col(f"casualties.{c}").alias(c) for c in CASUALTIES])


def nest(flat: DataFrame) -> DataFrame:
    """The inverse of flatten()."""
    inner = {"state", "lga", "town", "coordinates", *CASUALTIES}
    plain = [c for c in flat.columns if c not in inner]
    return flat.select(*plain, F.struct("state", "lga", "town", "coordinates").alias("location"), F.struct(*CASUALTIES).alias("casualties"))


#: The least and most characters of trimmed fields, and the most elements of lists.
LENGTHS = {"title": (5, 500), "description": (10, 5000), "state": (1, 100), "lga": (0, 100), "town": (0, 100), "group": (1, 200)}
URL_CHARS, SOURCE_TITLE_CHARS, PUBLISHER_CHARS, TAG_CHARS, MOST_SOURCES, MOST_TAGS = 2000, 500, 200, 50, 20, 20


def valid(flat: DataFrame) -> Column:
    """Whether a flat row meets the input rules: lengths (see LENGTHS), a date, whole counts that are not negative, a known status, sources with addresses, tags, and coordinates on the globe.

    LGA, town, counts, status, tags and coordinates may be null; columns that flat lacks are not looked at.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rules = [F.length(text(F.col(c))).between(*LENGTHS[c]) for c in LENGTHS] + [F.col("date").isNotNull()]
    rules += [F.coalesce(F.col(c), F.lit(0)) >= 0 for c in CASUALTIES]
    rules.append(F.coalesce("status", F.lit(STATUSES[1])).isin(*STATUSES))
    if "sources" in flat.columns:
        def good(s: Column) -> Column:
            address = F.try_parse_url(s["url"], F.lit("PROTOCOL")).isNotNull() & (F.length(s["url"]) <= URL_CHARS)
            return F.coalesce(address & (F.length(text(s["title"])) <= SOURCE_TITLE_CHARS) & (F.length(text(s["publisher"])) <= PUBLISHER_CHARS), F.lit(False))

        rules += [F.size(F.coalesce("sources", F.array())) <= MOST_SOURCES, F.forall(F.coalesce("sources", F.array()), good)]
    if "tags" in flat.columns:
        rules += [F.size(F.coalesce("tags", F.array())) <= MOST_TAGS, F.forall(F.coalesce("tags", F.array()), lambda t: F.length(text(t)) <= TAG_CHARS)]
    if "coordinates" in flat.columns:
        rules.append(F.col("coordinates").isNull() | F.coalesce(F.col("coordinates.lat").between(-90, 90) & F.col("coordinates.lng").between(-180, 180), F.lit(False)))
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return F.coalesce(out, F.lit(False))


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INCIDENT_DDL).parquet(path)


def insert_incidents(incidents: DataFrame, path: str) -> None:
    """Appends the incidents whose hash the table at `path` lacks, one row for each hash (the smallest _id): writing a batch again adds nothing. For one writer at a time; sources.store.Store.insert() is for several."""
    stored = read_incidents(incidents.sparkSession, path).select("hash")
    first = incidents.groupBy("hash").agg(F.min("_id").alias("_first"))
    own = incidents.join(first, "hash").where(F.col("_id") == F.col("_first")).drop("_first").select(incidents.columns)
    write_incidents(own.join(stored, "hash", "left_anti").select(incidents.columns), path)


def write_incidents(incidents: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by year and month, sorted by date inside files: a filter on `ym` (see filters.where) prunes partitions, one on the date row groups. A month of very many rows is written by many tasks."""
    dated = incidents.withColumn("ym", F.date_format("date", "yyyy-MM"))
    dated.repartitionByRange("ym", "date", "_id").sortWithinPartitions("ym", "date").write.mode(mode).partitionBy("ym").parquet(path)
