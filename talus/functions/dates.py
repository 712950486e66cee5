"""Date functions; every day and month is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

FIRST_YEAR = 2015
_MONTH = "(" + "|".join(V.MONTHS) + ")"
_DAY, _TO_YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", r"(?:,\s*|\s+)(20\d{2})(?![A-Za-z0-9_])"
_EDGE = "(?<![A-Za-z0-9_])"
#: How narratives write dates, in order of trust, with the groups of month, day and year.
NARRATIVE = [
    (rf"(?i){_EDGE}(?:On\s+)?{_MONTH}\s+{_DAY}\s*(?:or|/|-)\s*{_DAY}{_TO_YEAR}", 1, 2, 4),
    (rf"(?i){_EDGE}On\s+{_MONTH}\s+{_DAY}{_TO_YEAR}", 1, 2, 3),
    (rf"(?i){_EDGE}(?:On\s+)?{_MONTH}\s+{_DAY}{_TO_YEAR}", 1, 2, 3),
    (rf"(?i){_EDGE}(?:On|Since)\s+(\d{{1,2}})\s+{_MONTH}{_TO_YEAR}", 2, 1, 3),
]


def loose_date(c: Column, as_of_year: int = 2100) -> Column:
    """A timestamp from a text, if its year is plausible."""
    t = F.try_to_timestamp(F.nullif(c, F.lit("")))
    return F.when(F.year(t).between(FIRST_YEAR, as_of_year + 1), t)


def narrative_date(c: Column | str, as_of_year: int = 2100) -> Column:
    """Noon of the first date that a narrative names, by the patterns in order; days past a month's end roll over."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    months = F.create_map(*[x for i, m in enumerate(V.MONTHS, 1) for x in (F.lit(m.lower()), F.lit(i))])
    out = []
    for pattern, month, day, year in NARRATIVE:
        m = F.try_element_at(months, F.lower(F.regexp_extract(c, pattern, month)))
        d, y = F.expr("null").cast("int"), None
        d = F.regexp_extract(c, pattern, day).try_cast("int")
        y = F.regexp_extract(c, pattern, year).try_cast("int")
        at = F.date_add(F.make_date(y, m, F.lit(1)), d - 1).cast("timestamp") + F.expr("INTERVAL 12 HOURS")
        out.append(F.when(m.isNotNull() & d.between(1, 31) & y.between(FIRST_YEAR, as_of_year + 1), at))
    return F.coalesce(*out)


def _days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_millis(a) - F.unix_millis(b)) / 86_400_000


def reconcile(parsed: Column, hint: Column) -> Column:
    """The hint if it is 7 to 60 days from the parsed date."""
    return F.when(_days_apart(parsed, hint).between(7, 60), hint).otherwise(parsed)


def date_fix(parsed: Column, hint: Column) -> Column:
    """The hint where it corrects a date to another month; else null."""
    return F.when(_days_apart(parsed, hint).between(7, 60) & (F.month(parsed) != F.month(hint)), hint)


def day_window(c: Column, days: int) -> tuple[Column, Column]:
    """From the start of the day `days` before to the end (exclusive) of the day as many after."""
    day = F.date_trunc("day", c)
    return day - F.expr(f"INTERVAL {days} DAYS"), day + F.expr(f"INTERVAL {days + 1} DAYS")


def month_windows(month: Column, as_of: Column) -> Column:
    """Pieces of 14 days of a month (its first day), the last cut at the month's end or as_of."""
    last = F.least(F.last_day(month), as_of.cast("date"))
    starts = F.sequence(month, F.greatest(last, month), F.expr("INTERVAL 14 DAYS"))
    return F.transform(starts, lambda s: F.struct(s.cast("date").alias("first"), F.least(F.date_add(s.cast("date"), 13), last).alias("last")))


def anchor_dates(first: Column, last: Column, step: int = 4) -> Column:
    """Days from the first in steps, and the last, newest first."""
    return F.sort_array(F.array_union(F.sequence(first, last, F.expr(f"INTERVAL {step} DAYS")), F.array(last)), asc=False)


def month_options(first: Column, as_of: Column) -> Column:
    return F.reverse(F.transform(F.sequence(F.trunc(first, "month"), F.trunc(as_of, "month"), F.expr("INTERVAL 1 MONTH")), lambda m: F.date_format(m, "yyyy-MM")))


def time_since(c: Column, as_of: Column) -> Column:
    """Days, hours, minutes and seconds since a time; none is negative."""
    s = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(c)) / 1_000_000))
    return F.struct(F.floor(s / 86400).alias("days"), F.floor(s % 86400 / 3600).alias("hours"), F.floor(s % 3600 / 60).alias("minutes"), (s % 60).cast("long").alias("seconds"))
