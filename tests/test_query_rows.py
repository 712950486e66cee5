"""Queries of several steps, against plain Python over all of their rows."""

import os
import re
from collections import defaultdict
from urllib.parse import quote, urlsplit

import pytest

from talus import catalog
from talus.functions import values
from talus.plans import views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(text):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s/-]", " ", (text or "").lower())).strip()


def tokens(text, least):
    return [w for w in plain(text).split() if len(w) >= least and w not in values.SOURCE_STOPWORDS]


def domain(url):
    host = (urlsplit(url).hostname or "") if "://" in url and not url.startswith(" ") else ""
    return re.sub(r"^www\.", "", host.lower())


@pytest.fixture(scope="module")
def reports(spark):
    """(id, title, description, state, publisher, chunks) of what the three queries of chunks read."""
    out = []
    for r in views.reports(spark, SF).select("event_id", "title", "description", "state_raw", "publisher").collect():
        k = [r.event_id * 3 + pos for pos in range(5)]
        out.append((r.event_id, r.title, r.description, r.state_raw, r.publisher, [(views.URLS_SEEN[i % len(views.URLS_SEEN)], views.TITLES[i % len(views.TITLES)]) for i in k]))
    return out


def got(spark, name):
    return {r._id: r.urls for r in catalog.QUERIES[name](spark, SF).collect()}


def test_join_chunk_rank(spark, reports):
    want = {}
    for i, title, description, state, publisher, chunks in reports:
        places = {w for w in tokens(state, 3) + tokens("Jos", 3) if w != "unknown"}
        meaning = set(tokens(title, 4) + tokens("bandits", 4) + tokens(description, 4)[:12]) - places
        host = next((h for name, h in values.PUBLISHER_TIERS if name in publisher.lower()), None)
        found = []
        for pos, (url, c_title) in enumerate(chunks):
            own, d = set(tokens(f"{c_title} {url}", 3)), domain(url)
            at, about = len(places & own), len(meaning & own)
            relevant = (at >= 1 and about >= 1) or about >= 2
            score = sum(w in set(tokens(title, 3)) for w in tokens(c_title, 3)) + 2 * any(p in plain(publisher) and x in d for p, x in values.PUBLISHER_DOMAINS) + 2 * relevant
            root = ".".join(d.split(".")[-2:]) if d.count(".") > 1 else d
            trusted = d in values.TRUSTED_DOMAINS or root in values.TRUSTED_DOMAINS
            tier = 1 if score >= 2 else 2 if host and (d == host or d.endswith(f".{host}")) else 3 if trusted and relevant else 4 if trusted else None
            if tier:
                found.append((tier, -score, pos, url))
        want[i] = min(found)[3] if found else "https://x.y/grounding-api-redirect/1"
    assert got(spark, "join_chunk_rank") == want and len(set(want.values())) > 5


def test_join_gap_chunks(spark, reports):
    want = {}
    for i, title, _, state, _, chunks in reports:
        event = set(tokens(title, 4) + tokens(state, 3) + tokens("Jos", 3) + tokens("bandits", 4))
        scores = [(-(2 * sum(w in tokens(title, 3) for w in tokens(t, 3)) + sum(w in event for w in tokens(t, 3))), pos, url) for pos, (url, t) in enumerate(chunks)]
        best = min(scores)
        want[i] = best[2] if best[0] <= -2 else ""
    assert got(spark, "join_gap_chunks") == want and len(set(want.values())) > 5


def test_join_title_chunks(spark, reports):
    want = {}
    for i, title, _, _, _, chunks in reports:
        hit = next((url for url, t in chunks if title.lower() in t.lower() or t.lower() in title.lower()), None)
        want[i] = hit if hit is not None else "https://www.google.com/search?q=" + quote(title, safe="")
    assert got(spark, "join_title_chunks") == want and len(set(want.values())) > 5


def test_normalized_reports(spark):
    """Whose source is trusted and usable, and who is no operational update: each rule by its own query; no narrative here tells a date near enough."""
    flags = {r.event_id: r.flagged for r in catalog.QUERIES["classify_ops_update"](spark, SF).collect()}
    states = {r.event_id: r.state for r in catalog.QUERIES["normalize_state"](spark, SF).collect()}
    want = {}
    for r in views.reports(spark, SF).select("event_id", "url", "publisher", "ts").collect():
        d, name = domain(r.url), r.publisher.lower()
        banned = any(b in name or b in r.url.lower() for b in values.BANNED_SOURCES)
        root = ".".join(d.split(".")[-2:]) if d.count(".") > 1 else d
        trusted = not banned and (d in values.TRUSTED_DOMAINS or root in values.TRUSTED_DOMAINS or any(p.lower() in name for p in values.TRUSTED_PUBLISHERS))
        path = urlsplit(r.url).path.lower() if d else ""
        usable = r.url.lower().startswith(("http://", "https://")) and d != values.REDIRECTOR_HOST and not (d.endswith("google.com") and path.startswith("/search")) and len(path) >= 3 and not path.endswith(tuple(values.ASSET_EXTENSIONS))
        if trusted and usable and not flags[r.event_id]:
            want[r.event_id] = (states[r.event_id], f"{r.ts:%Y-%m-%d %H:%M:%S}", r.url)
    found = {r._id: (r.state, r.date, r.urls) for r in catalog.QUERIES["normalized_reports"](spark, SF).collect()}
    assert found == want and 0 < len(want) < len(flags)


def test_repair_quality(spark):
    def urls(sources):
        return {u for s in sources if (u := re.sub(r"/$", "", s.url.strip().lower()))}

    rows = {}
    for r in catalog._border(spark, SF).select("_id", "date", "state", "town", "description", "sources", "_deleted").collect():
        if not r._deleted and r.date.year == 1996:
            rows[r._id] = {"day": r.date.date(), "state": r.state, "town": r.town, "length": len(r.description), "n": len(r.sources), "urls": urls(r.sources)}
    clusters = defaultdict(list)
    for i, r in rows.items():
        clusters[r["day"], i % 40].append(i)
    want = set()
    for ids in clusters.values():
        first, *others = sorted(ids, key=lambda i: (-rows[i]["n"], -rows[i]["length"], i))
        for i in others:
            want.add(("exact", i, first))
            rows[first]["urls"] |= rows[i]["urls"]
        if others:
            rows[first]["n"] = len(rows[first]["urls"])
    rows = {i: r for i, r in rows.items() if i not in {x[1] for x in want}}
    exact = len(want)
    pairs = set()
    for a in rows:
        for b in rows:
            if a < b and rows[a]["day"] == rows[b]["day"] and rows[a]["town"] == rows[b]["town"] and rows[a]["state"] != rows[b]["state"]:
                weigh = lambda i: (rows[i]["n"], rows[i]["length"], -i)
                pairs.add((a, b) if weigh(a) >= weigh(b) else (b, a))
    gone = {d for _, d in pairs}
    for d in gone:
        if kept := [k for k, x in pairs if x == d and k not in gone]:
            want.add(("cross-state", d, min(kept)))
    done = {(r.step, r._id, r.kept) for r in catalog.QUERIES["repair_quality"](spark, SF).collect()}
    # No narrative of these reports tells a date within sixty days.
    assert done == want
    assert exact and len(want) > exact
