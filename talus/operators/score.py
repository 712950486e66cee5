"""The duplicate score of two incidents, from features computed once a row before any pair is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import any_of, holds_any, is_unknown_place, keywords, normalize_state, overlap, similarity, text, town_forms, towns_met
from ..functions.urls import normalize_url

WINDOW_DAYS, THRESHOLD = 8, 0.4


def features(flat: DataFrame) -> DataFrame:
    """What the score needs of each row, computed before pairs are made: word sets (those of descriptions as 64-bit hashes), lower-cased fields, source addresses and the day; whole texts stay behind."""
    urls = F.array_distinct(F.filter(F.transform(F.coalesce("sources", F.array()), lambda s: normalize_url(s["url"])), lambda u: u != ""))
    wide = flat.withColumns({
        "f_state": normalize_state("state"), "f_town": F.lower(text("town")), "f_lga": F.lower(text("lga")), "f_group": F.lower(text("group")),
        "f_title": F.lower(text("title")), "f_title_words": keywords("title"), "f_words": F.transform(keywords("description"), lambda w: F.xxhash64(w)), "f_urls": urls,
        "f_no_town": is_unknown_place("town"), **{f"f_town_{k}": v for k, v in town_forms("town").items()}, "f_no_lga": is_unknown_place("lga"), "f_day": F.col("date").cast("date"),
    })
    return wide.select("_id", "date", "town", "killed", *[c for c in ("createdAt",) if c in flat.columns], *[c for c in wide.columns if c.startswith("f_")])


def measures(a: str = "a", b: str = "b") -> dict[str, Column]:
    """What several parts of the score, and its reason, go by: how like towns, LGAs and groups are, whether one town is written as the other, and the overlap of titles."""
    return {
        "m_town": similarity(f"{a}.f_town", f"{b}.f_town"), "m_lga": similarity(f"{a}.f_lga", f"{b}.f_lga"), "m_alias": towns_met(*[{k: F.col(f"{x}.f_town_{k}") for k in ("name", "words", "parts")} for x in (a, b)]),
        "m_group": similarity(f"{a}.f_group", f"{b}.f_group"), "m_title": title_overlap(a, b),
    }


def location_score(a: str, b: str, m: dict[str, Column] | None = None) -> Column:
    m = measures(a, b) if m is None else m
    town, lga = m["m_town"], m["m_lga"]
    known = ~F.col(f"{a}.f_no_lga") & ~F.col(f"{b}.f_no_lga")
    both_towns = ~F.col(f"{a}.f_no_town") & ~F.col(f"{b}.f_no_town")
    base = F.when(both_towns, F.when(m["m_alias"] | (town > 0.75), 0.4).when(town > 0.5, 0.2).otherwise(0.0)).otherwise(F.when(known & (lga > 0.75), 0.3).otherwise(0.0))
    near = known & (lga > 0.75)
    return F.when(base > 0, F.when(near, F.least(base + 0.1, F.lit(0.5))).otherwise(base)).otherwise(F.when(known & (lga > 0.85), 0.25).otherwise(0.0))


def group_score(a: str, b: str, m: dict[str, Column] | None = None) -> Column:
    alike = (measures(a, b) if m is None else m)["m_group"]
    x, y = F.col(f"{a}.f_group"), F.col(f"{b}.f_group")
    both = any_of([F.contains(x, F.lit(w)) & F.contains(y, F.lit(w)) for w in ("bandit", "militant")])
    return F.when((alike > 0.6) | holds_any(x, V.VAGUE_GROUPS) | holds_any(y, V.VAGUE_GROUPS) | both, 0.15).otherwise(0.0)


def casualty_score(a: Column, b: Column) -> Column:
    x, y = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    ratio = F.least(x, y) / F.greatest(x, y, F.lit(1))
    return F.when((x == 0) & (y == 0), 0.1).when((x == 0) | (y == 0), 0.05).when(ratio > 0.5, 0.2).when(ratio > 0.3, 0.1).otherwise(0.0)


def date_proximity(a: Column, b: Column) -> Column:
    gap = F.abs(F.unix_millis(a) - F.unix_millis(b))
    return F.when(gap < 86_400_000, 0.1).when(gap < 2 * 86_400_000, 0.05).otherwise(0.0)


#: The most that the parts with costly measures can add.
MOST = {"s_alike": 0.25, "s_words": 0.15}


def alike_or_less(a: Column, b: Column) -> Column:
    """The similarity of two texts where it is above 0.7, else at most that: the edit distance is not followed beyond what counts."""
    n = F.greatest(F.length(a), F.length(b))
    # (n - d) / n > 0.7 needs d < 0.3 n.
    d = F.call_function("levenshtein", a, b, F.ceil(n * F.lit(0.3)).cast("int"))
    return alike_by(d, n)


def alike_by(d: Column, n: Column) -> Column:
    """alike_or_less() of an edit distance (-1: beyond what counts) and the longer length."""
    return F.when(n == 0, F.lit(1.0)).when(d >= 0, (n - d) / n).otherwise(F.lit(0.0))


def alike_score(alike: Column) -> Column:
    return F.when(alike > 0.85, 0.25).when(alike > 0.7, 0.15).otherwise(0.0)


def words_score(words: Column) -> Column:
    return F.when(words > 0.4, 0.15).when(words > 0.25, 0.08).otherwise(0.0)


def title_overlap(a: str, b: str) -> Column:
    return overlap(F.col(f"{a}.f_title_words"), F.col(f"{b}.f_title_words"))


def parts(a: str = "a", b: str = "b", m: dict[str, Column] | None = None) -> dict[str, Column]:
    """The eight parts of the score of two aliased feature rows, in the order in which they are added; m are its measures where these are columns already."""
    m = measures(a, b) if m is None else m
    title = m["m_title"]
    return {
        "s_location": location_score(a, b, m),
        "s_group": group_score(a, b, m),
        "s_casualty": casualty_score(F.col(f"{a}.killed"), F.col(f"{b}.killed")),
        "s_title": F.when(title > 0.5, 0.2).when(title > 0.3, 0.1).otherwise(0.0),
        "s_alike": alike_score(alike_or_less(F.col(f"{a}.f_title"), F.col(f"{b}.f_title"))),
        "s_words": words_score(overlap(F.col(f"{a}.f_words"), F.col(f"{b}.f_words"))),
        "s_source": F.when(F.coalesce(F.arrays_overlap(f"{a}.f_urls", f"{b}.f_urls"), F.lit(False)), 0.3).otherwise(0.0),
        "s_date": date_proximity(F.col(f"{a}.date"), F.col(f"{b}.date")),
    }


#: The names of parts() in the order in which they are added.
ORDER = ("s_location", "s_group", "s_casualty", "s_title", "s_alike", "s_words", "s_source", "s_date")


def total(columns: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for c in columns.values():
        out = out + c
    return out


def told(a: str = "a", b: str = "b") -> dict[str, Column]:
    """What the reason tells beside parts and measures: which places are known, and both counts."""
    count = lambda x: F.coalesce(F.col(f"{x}.killed"), F.lit(0))
    return {"d_towns": ~F.col(f"{a}.f_no_town") & ~F.col(f"{b}.f_no_town"), "d_lgas": ~F.col(f"{a}.f_no_lga") & ~F.col(f"{b}.f_no_lga"), "d_killed_a": count(a), "d_killed_b": count(b)}


def _place() -> Column:
    """How places met, from the columns of measures() and told()."""
    town, lga, known = F.col("m_town"), F.col("m_lga"), F.col("d_lgas")
    shown = lambda name, x: F.format_string(f"{name}(%.2f)", x)
    by_town = F.when(F.col("m_alias"), "town-match(alias)").when(town > 0.75, shown("town-match", town)).when(town > 0.5, shown("town-partial", town)).when(known & (lga > 0.85), shown("lga-fallback", lga)).otherwise("")
    return F.when(F.col("d_towns"), by_town).otherwise(F.when(known & (lga > 0.75), shown("lga-match", lga)).otherwise("location-unknown"))


def reason(raw: Column) -> Column:
    """The score explained, from the columns of parts(), measures() and told(), and the measures d_alike and d_words."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    said = [
        ("Score: ", F.format_string("%.2f", raw)), (" (Loc: ", two("s_location")), (" [", _place()), ("], Grp: ", two("s_group")), (", Cas: ", two("s_casualty")), (" [", F.concat(F.col("d_killed_a").cast("string"), F.lit("v"), F.col("d_killed_b").cast("string"))), ("], Title: ", two("s_title")),
        (" [kw:", two("m_title")), (", sim:", two("d_alike")), ("+", two("s_alike")), ("], Desc: ", two("s_words")), (" [", two("d_words")), ("], Src: ", two("s_source")), (", Date: ", two("s_date")),
    ]
    return F.concat(*[x for label, value in said for x in (F.lit(label), value)], F.lit(")"))
