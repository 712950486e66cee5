"""Text functions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def trim_all(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def any_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, however often `use` names it: an expression that stands in several places, or within a lambda, is else computed as often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def holds_any(c: Column, needles: list[str]) -> Column:
    return any_of([F.contains(c, F.lit(n)) for n in needles])


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 minus the edit distance as a part of the longer length; two empty texts are alike."""
    a, b = col(a), col(b)
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise((n - F.levenshtein(a, b)) / n)


def words(c: Column | str, least: int, stop: list[str], keep: str = "a-z0-9") -> Column:
    """Distinct lower-case words of at least `least` characters that are not stop words, in order."""
    split = F.split(F.regexp_replace(F.lower(text(c)), rf"[^{keep}\s]", " "), r"\s+")
    return F.array_distinct(F.filter(split, lambda w: (F.length(w) >= least) & ~w.isin(stop)))


def keywords(c: Column | str) -> Column:
    return words(c, 3, V.KEYWORD_STOPWORDS)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two arrays without repeats; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def whole_count(c: Column | str) -> Column:
    """The whole number that a text begins with, white space and sign allowed; null where there is none, or none that fits."""
    return F.regexp_extract(text(c), r"^\s*([+-]?\d+)", 1).try_cast("int")


def is_unknown_place(c: Column | str) -> Column:
    return F.lower(trim_all(text(c))).isin(V.UNKNOWN_PLACES)


def _town_parts(t: Column) -> Column:
    """A town's name without what is in parentheses, and what is in them."""
    both = F.array(trim_all(F.regexp_replace(t, r"\s*\(.*\)\s*", "")), trim_all(F.regexp_extract(t, r"\(([^)]+)\)", 1)))
    return F.filter(both, lambda x: x != "")


def town_forms(c: Column | str) -> dict[str, Column]:
    """What towns_met() needs of a town: its name lower-cased, its words, and its names without and within parentheses."""
    name = F.lower(trim_all(text(c)))
    return {"name": name, "words": words(name, 3, V.TOWN_FILLERS), "parts": _town_parts(name)}


def towns_met(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """One name inside the other, a shared word, or a name that is close to the other's: of the forms of two towns."""
    shared = F.arrays_overlap(a["words"], b["words"])
    close = F.exists(a["parts"], lambda x: F.exists(b["parts"], lambda y: F.contains(x, y) | F.contains(y, x) | (similarity(x, y) > 0.75)))
    return (a["name"] != "") & (b["name"] != "") & (F.contains(a["name"], b["name"]) | F.contains(b["name"], a["name"]) | F.coalesce(shared, F.lit(False)) | close)


def towns_overlap(a: Column | str, b: Column | str) -> Column:
    """towns_met() of two towns written in several ways."""
    return towns_met(town_forms(a), town_forms(b))


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_state(c: Column | str) -> Column:
    """The canonical name of a state: the first of several, without "State", by alias or name; any other with a capital first letter."""
    names, aliases = _lookup({x.lower(): x for x in V.STATES}), _lookup(V.STATE_ALIASES)

    def first(s: Column) -> Column:
        several = s.rlike(r"[/;]") | s.rlike(r"(?i)(?<![A-Za-z0-9_])and(?![A-Za-z0-9_])")
        parts = F.filter(F.transform(F.split(s, r"[/;]|(?i)\s+and\s+"), trim_all), lambda p: p != "")
        return F.when(several, F.coalesce(F.try_element_at(parts, F.lit(1)), s)).otherwise(s)

    def named(bare: Column) -> Column:
        cleaned = trim_all(F.regexp_replace(F.regexp_replace(bare, r"[-_]+", " "), r"\s+", " "))
        found = F.coalesce(F.try_element_at(aliases, F.lower(bare)), F.try_element_at(names, F.lower(bare)), F.try_element_at(names, F.lower(cleaned)))
        return F.coalesce(found, F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1_000_000)))

    bare = bound(trim_all(c), lambda s: trim_all(F.regexp_replace(first(s), r"(?i)\s+state$", "")))
    return F.when(text(c) == "", "Unknown").otherwise(bound(bare, named))


def states_match(a: Column | str, b: Column | str) -> Column:
    """Equal by name, or sharing one of several names."""
    def every(c: Column) -> Column:
        return F.filter(F.transform(F.split(c, r"[/;]|(?i)\s+and\s+"), lambda p: normalize_state(p)), lambda p: p != "Unknown")

    a, b = text(a), text(b)
    return (a != "") & (b != "") & ((normalize_state(a) == normalize_state(b)) | F.coalesce(F.arrays_overlap(every(a), every(b)), F.lit(False)))


def sanitize(c: Column | str, most: int = 5000) -> Column:
    """Without template marks and control characters, trimmed, at most `most` characters."""
    plain = F.regexp_replace(F.regexp_replace(col(c), r"[${}]", ""), r"[\x00-\x1f\x7f]", "")
    return F.substring(trim_all(plain), 1, most)


def normalize_text(c: Column | str, keep: str = r"a-z0-9\s/-") -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(F.lower(text(c)), f"[^{keep}]", " "), r"\s+", " "))


def tokenize(c: Column | str, least: int = 4) -> Column:
    return F.filter(F.split(normalize_text(c), r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(V.SOURCE_STOPWORDS))


def normalize_title(c: Column | str) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(normalize_text(c, r"a-z0-9\s"), r"(?<![a-z0-9_])(?:nigeria|nigerian|state)(?![a-z0-9_])", " "), r"\s+", " "))


def title_tokens(c: Column | str) -> Column:
    """The distinct words of more than three characters of normalize_title(), in order: split at once, for each of its patterns costs as much as this one."""
    dropped = ["nigeria", "nigerian", "state", *V.TITLE_OVERLAP_STOPWORDS]
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), "[^a-z0-9]+"), lambda w: (F.length(w) > 3) & ~w.isin(dropped)))


def attack_hash(date: Column, state: Column | str, lga: Column | str, town: Column | str, group: Column | str) -> Column:
    """SHA-256 of day, state, town (the LGA if the town is unknown) and group: equal for reports of one event."""
    unknown = lambda t: (t == "") | (t == "unknown") | F.startswith(t, F.lit("unknown "))
    place = bound(F.lower(trim_all(text(town))), lambda t: F.when(unknown(t), F.lower(trim_all(F.when(text(lga) == "", "unknown").otherwise(col(lga))))).otherwise(t))
    return F.sha2(F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), F.lower(normalize_state(state)), place, F.lower(trim_all(group))), 256)


def truncated(c: Column | str, most: int = 200) -> Column:
    return F.concat(F.substring(col(c), 1, most), F.lit("..."))


def location_label(town: str, lga: str, state: str) -> Column:
    def known(c: str) -> Column:
        return F.when((text(c) != "") & (F.col(c) != "Unknown"), F.col(c))

    return F.concat_ws(", ", known(town), known(lga), known(state))


def source_label(publisher: str, title: str) -> Column:
    return F.coalesce(F.nullif(F.col(publisher), F.lit("")), F.nullif(F.col(title), F.lit("")), F.lit("Source"))
