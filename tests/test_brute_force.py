"""Queries that SQL does not express, against plain Python over the same rows."""

import datetime as dt
import os
import re
from urllib.parse import urlsplit

import pytest

from talus import catalog
from talus.functions import urls, values
from talus.plans import views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_fixed_window_limit(spark):
    hits = sorted((r.user_id, r.ts, r.event_id) for r in views.load(spark, SF, "events").select("user_id", "event_id", "ts").collect())
    want, user = {}, None
    for u, ts, e in hits:
        if u != user or ts > opened + dt.timedelta(seconds=3600):  # noqa: F821
            user, opened, count = u, ts, 0
        want[e] = count < 2
        count += want[e]
    assert {r.event_id: r.allowed for r in catalog.QUERIES["fixed_window_limit"](spark, SF).collect()} == want


def test_http_verdict(spark):
    want = {}
    for r in views.load(spark, SF, "pages").select("page_id").collect():
        status, kind = [200, 404, 503, None][r.page_id % 4], "image/png" if r.page_id % 8 == 0 else "text/html; charset=utf-8"
        want[r.page_id] = "404 not found" if status == 404 else "wrong content-type: image/png" if status == 200 and kind == "image/png" else None
    assert {r.page_id: r.reason for r in catalog.QUERIES["http_verdict"](spark, SF).collect()} == want


def day(text):
    for form in ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            found = dt.datetime.strptime(text, form)
        except ValueError:
            continue
        return found if 2015 <= found.year <= 2101 else None
    return None


def test_published_date(spark):
    rows = [
        ('<script>{"datePublished": "2026-04-09T10:00:00Z"}</script><time datetime="2020-01-01">', "https://a.b/x"), ('<meta property="article:published_time" content="2025-03-02">', "https://a.b/x"),
        ("<meta name='pubdate' content='2024-01-05'>", "x"), ('{"dateCreated":"2023-02-03"}', "x"), ('<time class="c" datetime="2022-10-11T12:13:14Z">', "x"), ("<p>none</p>", "https://a.b/2021/05/06/x"), ('{"datePublished": "1999-01-01"}', "https://a.b/2021-07-08"), (None, None),
    ]
    df = spark.createDataFrame(rows, "html string, url string").coalesce(1)
    patterns = [r'"datePublished"\s*:\s*"([^"]+)"', r'"dateCreated"\s*:\s*"([^"]+)"', r"""property=["']article:published_time["'][^>]*content=["']([^"']+)["']""", r"""name=["']pubdate["'][^>]*content=["']([^"']+)["']""", r"""<time[^>]+datetime=["']([^"']+)["']"""]
    want = []
    for html, url in rows:
        found = [day(m[1]) for p in patterns if (m := re.search(p, html or "", re.I))]
        m = re.search(r"(20\d{2})[/-](\d{2})[/-](\d{2})", url or "")
        found.append(day(f"{m[1]}-{m[2]}-{m[3]}T12:00:00Z") if m else None)
        want.append(next((x for x in found if x), None))
    assert [r.at for r in df.select(urls.published_date("html", "url").alias("at")).collect()] == want
    assert catalog.QUERIES["published_date"](spark, SF).count() == views.load(spark, SF, "pages").count()


def tokens(text, least):
    plain = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s/-]", " ", (text or "").lower())).strip()
    return [w for w in plain.split() if len(w) >= least and w not in values.SOURCE_STOPWORDS]


def test_source_relevant_and_chunk_score(spark):
    want = {}
    for r in views.reports(spark, SF).select("event_id", "title", "description", "state_raw", "url", "publisher").collect():
        places = {w for w in tokens(r.state_raw, 3) + tokens("Jos", 3) if w != "unknown"}
        meaning = (set(tokens(r.title, 4) + tokens("bandits", 4) + tokens(r.description, 4)[:12])) - places
        own = set(tokens(f"{r.title} {r.url}", 3))
        at, about = len(places & own), len(meaning & own)
        relevant = (at >= 1 and about >= 1) or about >= 2
        shared = sum(w in set(tokens(r.title, 3)) for w in tokens(r.description, 3))
        name, domain = " ".join(re.sub(r"[^a-z0-9\s/-]", " ", r.publisher.lower()).split()), re.sub(r"^www\.", "", (urlsplit(r.url).hostname or "") if "://" in r.url and not r.url.startswith(" ") else "")
        score = shared + 2 * any(p in name and d in domain for p, d in values.PUBLISHER_DOMAINS) + 2 * relevant
        want[r.event_id] = (relevant, score)
    got = {r.event_id: (r.relevant, r.score) for r in catalog.QUERIES["source_relevant"](spark, SF).collect()}
    assert got == want


def test_fix_sources(spark):
    """Of the sources of each active incident all are articles: kept, or the incident goes for want of any."""
    rows = views.incidents(spark, SF, sources=True).select("_id", "_deleted", "sources").collect()
    want = {r._id: ("keep" if r.sources else "delete", len(r.sources)) for r in rows if not r._deleted}
    assert {r._id: (r.action, r.n) for r in catalog.QUERIES["fix_sources"](spark, SF).collect()} == want


def test_ingest_plan(spark):
    """Which reports merge, by a pass over all stored rows for each: the hash rule, and who is inserted."""
    got = {r.raw_id: r for r in catalog.QUERIES["ingest_plan"](spark, SF).collect()}
    narrow = {r.raw_id: r.match_id for r in catalog.QUERIES["join_narrow_fuzzy"](spark, SF).collect()}
    broad = {r.raw_id: r.match_id for r in catalog.QUERIES["join_broad_followup"](spark, SF).collect()}
    rows = views.incidents(spark, SF).select("_id", "date", "state", "lga", "town", "group").collect()
    place = lambda r: (r.lga or "unknown").lower() if r.town.lower() == "unknown" else r.town.lower()
    key = {r._id: (r.date.date(), r.state.lower(), place(r), r.group.lower()) for r in rows}
    stored = {}
    for i in sorted(key):
        if i % 10:
            stored.setdefault(key[i], i)
    for i in (i for i in key if i % 10 == 0):
        first = min(j for j in key if j % 10 == 0 and key[j] == key[i])
        if key[i] in stored:
            assert (got[i].action, got[i].target) == ("merge", stored[key[i]])
        elif i in narrow:
            assert (got[i].action, got[i].target) == ("merge", narrow[i])
        elif i in broad:
            assert (got[i].action, got[i].target) == ("merge_sources", broad[i])
        elif got[i].action == "insert":
            assert first == i and got[i].target is None
        else:
            assert got[i].action == "merge" and got[i].target is not None
