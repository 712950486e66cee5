"""Filters, order and pages of the incident list."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import normalize_state
from ..schema import CASUALTIES, STATUSES, active

MOST_ROWS = 2000


@dataclass(frozen=True)
class IncidentQuery:
    """What a reader asks of the list; a value out of range raises ValueError."""

    page: int = 1
    limit: int = 20
    state: str | None = None
    group: str | None = None
    status: str | None = None
    source: str | None = None
    month: str | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    search: str | None = None
    sort: str = "date-desc"
    casualty_type: str | None = None

    def __post_init__(self):
        if self.page < 1 or not 1 <= self.limit <= MOST_ROWS:
            raise ValueError(f"page must be 1 or more, limit 1 to {MOST_ROWS}")
        if self.sort not in ("date-desc", "date-asc", "casualties-desc"):
            raise ValueError(f"no such order: {self.sort}")
        if self.status is not None and self.status not in STATUSES:
            raise ValueError(f"no such status: {self.status}")
        if self.casualty_type is not None and self.casualty_type not in CASUALTIES[:3]:
            raise ValueError(f"no such casualty type: {self.casualty_type}")
        if self.month is not None:
            dt.datetime.strptime(self.month, "%Y-%m")


def state_is(name: str, column: str = "state") -> Column:
    """Case-insensitive equality with the canonical name; the capital territory has three spellings."""
    if name.strip().lower() in V.FCT_NAMES:
        return F.lower(column).isin(V.FCT_NAMES)
    return F.lower(column) == F.lower(normalize_state(F.lit(name)))


def in_month(month: str, column: str = "date") -> Column:
    first = F.to_timestamp(F.lit(f"{month}-01 00:00:00"))
    return (F.col(column) >= first) & (F.col(column) < F.add_months(first, 1).cast("timestamp"))


def mentions(needle: str) -> Column:
    """A case-insensitive substring of title, description, town or group."""
    n = F.lower(F.lit(needle))
    return F.coalesce(F.contains(F.lower("title"), n), F.lit(False)) | F.coalesce(F.contains(F.lower("description"), n), F.lit(False)) | F.coalesce(F.contains(F.lower("town"), n), F.lit(False)) | F.coalesce(F.contains(F.lower("group"), n), F.lit(False))


def _of_months(flat: DataFrame, q: IncidentQuery) -> DataFrame:
    """Where rows are kept by month (`ym`), those of the months that the query's dates can be in: a predicate of the partitions, so the folders of others are not read."""
    if "ym" not in flat.columns:
        return flat
    if q.month:
        return flat.where(F.col("ym") == q.month)
    out = flat.where(F.col("ym") >= f"{q.start:%Y-%m}") if q.start else flat
    # Rows without a date are kept as "none", behind all months.
    return out.where(F.col("ym") <= f"{q.end:%Y-%m}") if q.end else out


def where(flat: DataFrame, q: IncidentQuery) -> DataFrame:
    """Active rows that meet the query; a month takes precedence over start and end."""
    out = _of_months(flat.where(active()), q)
    if q.state:
        out = out.where(state_is(q.state))
    if q.group:
        out = out.where(F.contains(F.lower("group"), F.lower(F.lit(q.group))))
    if q.status:
        out = out.where(F.col("status") == q.status)
    if q.source:
        out = out.where(F.exists("sources", lambda s: s["publisher"] == q.source))
    if q.month:
        out = out.where(in_month(q.month))
    else:
        out = out.where(F.col("date") >= F.lit(q.start)) if q.start else out
        out = out.where(F.col("date") <= F.lit(q.end)) if q.end else out
    if q.search:
        out = out.where(mentions(q.search))
    if q.casualty_type:
        out = out.where(F.col(q.casualty_type) > 0)
    return out


def total_affected() -> Column:
    """Killed, injured and kidnapped, unknown counts as none; the displaced do not count."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in CASUALTIES[1:3]), F.coalesce(F.col("killed"), F.lit(0)))


def ordered(flat: DataFrame, sort: str) -> DataFrame:
    """Every order is total: _id decides between equals."""
    if sort == "casualties-desc":
        return flat.orderBy(total_affected().desc(), F.col("date").desc(), F.col("_id"))
    return flat.orderBy(F.col("date").asc() if sort == "date-asc" else F.col("date").desc(), F.col("_id"))


def page(flat: DataFrame, q: IncidentQuery) -> DataFrame:
    return ordered(where(flat, q), q.sort).offset((q.page - 1) * q.limit).limit(q.limit)


def totals(filtered: DataFrame) -> DataFrame:
    """One row: count, and sums with unknown as none; sums of no rows are 0."""
    return filtered.agg(F.count("*").alias("total"), *[F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c) for c in CASUALTIES[:3]])


def pagination(total: int, q: IncidentQuery) -> dict:
    pages = math.ceil(total / q.limit)
    return {"page": q.page, "limit": q.limit, "total": total, "totalPages": pages, "hasNext": q.page < pages, "hasPrev": q.page > 1}


def envelope(flat: DataFrame, q: IncidentQuery) -> tuple[DataFrame, dict, dict]:
    """The answer of the list: the page, the totals over all that the filters leave, and where the page is.

    One scan gives both: the totals are observed on the rows that the page is taken from. The page has MOST_ROWS rows at most.
    """
    seen = Observation()
    count = {c: F.sum(F.coalesce(F.col(c), F.lit(0))) for c in CASUALTIES[:3]}
    found = where(flat, q).observe(seen, F.count("*").alias("total"), *[v.alias(c) for c, v in count.items()])
    rows = ordered(found, q.sort).offset((q.page - 1) * q.limit).limit(q.limit).collect()
    sums = {c: seen.get[c] or 0 for c in count}
    return flat.sparkSession.createDataFrame(rows, flat.schema), sums, pagination(seen.get["total"], q)
