"""URL and page functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .dates import loose_date
from .text import any_of, bound, col, holds_any, normalize_text, text, tokenize, trim_all


def _host(c: Column) -> Column:
    return F.regexp_replace(F.lower(text(F.try_parse_url(c, F.lit("HOST")))), r"^www\.", "")


def _path(c: Column) -> Column:
    return F.lower(text(F.try_parse_url(c, F.lit("PATH"))))


def extract_domain(c: Column | str) -> Column:
    """Host without a leading www; an address that is none gives an empty text."""
    return _host(col(c))


def root_domain(domain: Column | str) -> Column:
    parts = F.split(col(domain), r"\.")
    return F.when(F.size(parts) > 2, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(col(domain))


def normalize_url(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(trim_all(text(c))), "/$", "")


def is_usable_url(c: Column | str) -> Column:
    """An http address of an article: no redirector, search page, home page or asset."""
    c = col(c)
    host, path = _host(c), _path(c)
    search = F.endswith(host, F.lit("google.com")) & F.startswith(path, F.lit("/search"))
    asset = any_of([F.endswith(path, F.lit(e)) for e in V.ASSET_EXTENSIONS])
    http = F.lower(text(F.try_parse_url(c, F.lit("PROTOCOL")))).isin("http", "https")
    return F.coalesce(http & (host != "") & (host != V.REDIRECTOR_HOST) & ~search & (F.length(path) >= 3) & ~asset, F.lit(False))


# The texts of the reasons.
def invalid_reason(c: Column | str) -> Column:
    """Why an address can be no source, or null."""
    c = col(c)
    host, path = F.lower(text(F.try_parse_url(c, F.lit("HOST")))), text(F.try_parse_url(c, F.lit("PATH")))
    extension = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    protocol = F.lower(text(F.try_parse_url(c, F.lit("PROTOCOL"))))
    return (
        F.when(protocol == "", "unparseable URL")
        .when(~protocol.isin("http", "https"), "non-http protocol")
        .when(F.contains(host, F.lit(V.REDIRECTOR_HOST)), "expired grounding link")
        .when(F.endswith(host, F.lit("google.com")) & F.startswith(path, F.lit("/search")), "search page")
        .when(F.length(path) < 3, "homepage (no article path)")
        .when(extension.isin(V.MORE_ASSET_EXTENSIONS), F.concat(F.lit("non-article file ("), extension, F.lit(")")))
    )


def is_trusted_source(url: Column | str, publisher: Column | str, domains: list[str] = V.TRUSTED_DOMAINS, publishers: list[str] = V.TRUSTED_PUBLISHERS, banned: list[str] = V.BANNED_SOURCES) -> Column:
    """No banned name in publisher or address, and a trusted domain, root domain or publisher."""
    domain, name = extract_domain(url), F.lower(text(publisher))
    bad = holds_any(name, banned) | holds_any(F.lower(text(url)), banned)
    return ~bad & (domain.isin(domains) | root_domain(domain).isin(domains) | holds_any(name, [p.lower() for p in publishers]))


def html_title(c: Column | str) -> Column:
    body = F.regexp_extract(text(c), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.substring(trim_all(F.regexp_replace(F.regexp_replace(body, "(?i)&amp;", "&"), r"\s+", " ")), 1, 300)


def url_date(c: Column | str) -> Column:
    """Noon of a date written in an address."""
    found = r"(20\d{2})[/-](\d{2})[/-](\d{2})"
    day = F.concat_ws("-", *[F.regexp_extract(text(c), found, i) for i in (1, 2, 3)])
    return loose_date(F.concat(day, F.lit("T12:00:00Z")))


# Where pages say when they were published, in order of trust.
PUBLISHED = [
    r"""(?i)"datePublished"\s*:\s*"([^"]+)\"""",
    r"""(?i)"dateCreated"\s*:\s*"([^"]+)\"""",
    r"""(?i)property=["']article:published_time["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)name=["']pubdate["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)name=["']publishdate["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)itemprop=["']datePublished["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)<time[^>]+datetime=["']([^"']+)["']""",
]


def published_date(html: Column | str, url: Column | str) -> Column:
    return F.coalesce(*[loose_date(F.regexp_extract(text(html), p, 1)) for p in PUBLISHED], url_date(url))


def location_tokens(state: Column | str, lga: Column | str, town: Column | str) -> Column:
    return F.filter(F.array_distinct(F.concat(tokenize(state, 3), tokenize(lga, 3), tokenize(town, 3))), lambda t: t != "unknown")


def semantic_tokens(title: Column | str, group: Column | str, description: Column | str, places: Column) -> Column:
    return F.array_except(F.concat(tokenize(title), tokenize(group), F.slice(tokenize(description), 1, 12)), places)


def source_relevant(places: Column, meaning: Column, title: Column | str, url: Column | str) -> Column:
    """A place and a word of the event, or two words, in the source's title and address."""
    own = F.array_distinct(tokenize(F.concat_ws(" ", text(title), text(url)), 3))
    met = bound(own, lambda o: F.struct(F.size(F.array_intersect(places, o)).alias("at"), F.size(F.array_intersect(meaning, o)).alias("about")))
    return bound(met, lambda m: ((m["at"] >= 1) & (m["about"] >= 1)) | (m["about"] >= 2))


def shared_words(theirs: Column, mine: Column) -> Column:
    """How many of their words, repeats too, are among mine."""
    return bound(mine, lambda m: F.size(F.filter(theirs, lambda t: F.array_contains(m, t))))


def chunk_score(source_title: Column | str, publisher: Column | str, chunk_title: Column | str, chunk_url: Column | str, relevant: Column) -> Column:
    """Shared title words, 2 more for the publisher's own domain, 2 more for relevance; -1 without titles."""
    mine, theirs = tokenize(source_title, 3), tokenize(chunk_title, 3)
    shared = shared_words(theirs, mine)
    both = F.struct(normalize_text(publisher).alias("name"), extract_domain(chunk_url).alias("domain"))
    own = bound(both, lambda x: any_of([F.contains(x["name"], F.lit(p)) & F.contains(x["domain"], F.lit(d)) for p, d in V.PUBLISHER_DOMAINS]))
    empty = (normalize_text(source_title) == "") | (normalize_text(chunk_title) == "")
    return F.when(empty, -1).otherwise(shared + F.when(own, 2).otherwise(0) + F.when(relevant, 2).otherwise(0))


def json_array(c: Column | str) -> Column:
    """The JSON array in a text, without code fences."""
    return F.regexp_extract(F.regexp_replace(text(c), "```(?:json)?", ""), r"(?s)(\[\s*[{\]].*)$", 1)


def lenient_json_array(c: Column | str) -> Column:
    """From the first bracket to the last, without code fences; an empty array where there are none."""
    found = F.regexp_extract(F.regexp_replace(text(c), "(?i)```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    return F.when(found == "", "[]").otherwise(found)


# The texts of the reasons.
def http_verdict(status: str, content_type: str, url: str, final_url: str) -> Column:
    """Why a fetched address is no valid source, or null; refusals, server errors and timeouts (null status) count as valid."""
    s, final = F.col(status), text(final_url)
    return (
        F.when(s == 404, "404 not found")
        .when(s.isNull() | s.isin(401, 403) | (s >= 500), None)
        .when(text(content_type).rlike("(?i)^(image|video|audio)/"), F.concat(F.lit("wrong content-type: "), F.element_at(F.split(F.col(content_type), ";"), 1)))
        .when((final != "") & (final != F.col(url)) & (F.length(text(F.try_parse_url(final, F.lit("PATH")))) < 3), "redirects to homepage")
    )
