"""Ingestion in order, against a pass over the reports one by one in plain Python."""

import datetime as dt
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from talus import catalog
from talus.operators import ingest
from talus.sources.files import settled

from .test_operators import DAY, flat, row

SF = "/root/testdata/sf0.001"
UNKNOWN = ["unknown", "unidentified", "armed men", "gunmen", "armed group", ""]


def low(x):
    return None if x is None else x.lower()


def same(a, b):
    return a is not None and b is not None and a.lower() == b.lower()


def words(t, least, stop):
    return [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", (t or "").lower())) if len(w) >= least and w not in stop]


def within(x, of, lo, hi):
    return x is not None and math.floor(of * lo) <= x <= math.ceil(of * hi)


def known(x):
    return (x or "").strip().lower() not in ("", "unknown")


def urls(sources):
    return {u for s in sources or [] if (u := re.sub(r"/$", "", (s["url"] or "").strip().lower()))}


def narrow(r, s):
    if not same(r["state"], s["state"]) or abs((r["date"].date() - s["date"].date()).days) > 2:
        return False
    lga, group = same(r["lga"] or "Unknown", s["lga"]), same(r["group"], s["group"])
    heads = words(r["title"], 4, ingest.TITLE_STOPWORDS)[:3]
    k, p = r["killed"] or 0, r["kidnapped"] or 0
    return (
        same(r["town"], s["town"]) or (lga and any(w in (low(s["town"]) or "") for w in words(r["town"], 3, ingest.TOWN_STOPWORDS))) or (lga and group) or (k > 0 and lga and within(s["killed"], k, 0.5, 1.5))
        or (len(heads) >= 2 and group and all(w in s["title"].lower() for w in heads)) or (k > 0 and p > 0 and group and s["killed"] == k and s["kidnapped"] == p)
    )


def broad(r, s):
    if s["_deleted"] or not same(r["state"], s["state"]):
        return False
    kl, kt, p = known(r["lga"]), known(r["town"]), r["kidnapped"] or 0
    lga = kl and same(r["lga"].strip(), s["lga"])
    return (
        (lga and p >= 10 and within(s["kidnapped"], p, 0.8, 1.2)) or (lga and kt and r["town"].strip().lower() in (low(s["town"]) or "")) or (p >= 50 and within(s["kidnapped"], p, 0.8, 1.2))
        or (lga and p >= 100 and within(s["kidnapped"], p, 0.6, 1.4)) or (kt and (r["group"] or "").strip().lower() not in UNKNOWN and same(r["town"].strip(), s["town"]) and same(r["group"], s["group"]) and abs(s["date"] - r["date"]) <= dt.timedelta(days=60))
    )


def cross(r, stored):
    if not known(r["town"]):
        return None
    near = [s for s in stored if not s["_deleted"] and same(r["town"].strip(), s["town"]) and s["state"] is not None and not same(r["state"], s["state"]) and abs((r["date"].date() - s["date"].date()).days) <= 1]
    for s in sorted(near, key=lambda s: (s["createdAt"], s["_id"]))[:10]:
        if urls(r["sources"]) & urls(s["sources"]) or ((r["killed"] or 0) >= 50 and within(s["killed"], r["killed"], 0.8, 1.2) and r["kidnapped"] == s["kidnapped"]):
            return s
    return None


def most(a, b):
    return b if a is None else a if b is None else max(a, b)


def once(sources):
    return [s for i, s in enumerate(sources or []) if urls([s]) and not urls([s]) <= urls(sources[:i])]


def fold(raw, stored):
    """(actions, rows after them) of raw reports in order of _id."""
    stored, acts = [dict(s) for s in stored], {}
    for r in sorted(raw, key=lambda r: r["_id"]):
        sources_only, hit = False, min((s for s in stored if s["hash"] == r["hash"]), key=lambda s: s["_id"], default=None)
        if hit is None and r["town"] is None:
            acts[r["_id"]] = ("error", None)
            continue
        if hit is None:
            hit = min((s for s in stored if narrow(r, s)), key=lambda s: (s["createdAt"], s["_id"]), default=None)
        if hit is None:
            hit = min((s for s in stored if broad(r, s)), key=lambda s: (s["date"], s["_id"]), default=None)
            sources_only = hit is not None
        hit = cross(r, stored) if hit is None else hit
        if hit is None:
            stored.append({**r, "lga": r["lga"] or "Unknown", "_deleted": False, "createdAt": ingest.LATEST, "sources": list(r["sources"] or [])})
            acts[r["_id"]] = ("insert", None)
            continue
        acts[r["_id"]] = ("merge_sources" if sources_only else "merge", hit["_id"])
        own = list(hit["sources"] or [])
        hit["sources"] = (own if sources_only else once(own)) + [s for s in once(r["sources"]) if not urls([s]) <= urls(own)]
        if not sources_only:
            hit.update({c: most(hit[c], r[c]) for c in ("killed", "injured", "kidnapped")})
            hit["status"] = "confirmed" if r["status"] == "confirmed" else hit["status"]
    return acts, {s["_id"]: s for s in stored}


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_is_a_pass_in_order(spark):
    raw, stored = catalog._raids(spark, SF)
    want, _ = fold(rows_of(ingest.with_hash(raw)), rows_of(ingest.with_hash(stored)))
    got = {r.raw_id: (r.action, r.target) for r in catalog.QUERIES["ingest_in_order"](spark, SF).collect()}
    assert got == want
    inside = {i for i in want if want[i][1] in want}
    # The case is worth something: reports merge into insertions of their batch, by each way of matching, and order matters.
    assert len(inside) > 20 and {want[i][0] for i in want} >= {"merge", "merge_sources", "insert"}
    at_once = {r.raw_id: (r.action, r.target) for r in ingest.plan(raw, ingest.with_hash(stored)).collect()}
    assert at_once != want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_applied_query_is_a_pass_in_order(spark):
    raw, stored = catalog._batch(spark, SF, sources=True)
    _, want = fold(rows_of(ingest.with_hash(ingest.usable(raw))), rows_of(ingest.with_hash(stored)))
    got = {r._id: r for r in catalog.QUERIES["ingest_applied"](spark, SF).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        assert (got[i].killed, got[i].kidnapped, got[i].status, got[i].hash) == (w["killed"], w["kidnapped"], w["status"], w["hash"])
        assert got[i].urls.split() == [s["url"] for s in w["sources"]]


def chains(spark):
    """Reports that reach each other only through what earlier ones have changed."""
    stored = flat(spark, row(1, killed=10, kidnapped=40, town="Wanka", urls=["https://a.b/one"]), row(2, state="Kebbi", town="Bena", lga="Danko", group="Militia", day=-3, urls=["https://a.b/two"]))
    raw = flat(
        spark,
        # A merge by town raises the counts to 30 and 200; then a report without place of its own is found by its counts, another by what is kidnapped, months later.
        row(10, killed=30, kidnapped=200, day=1, urls=["https://a.b/10"]), row(11, town="Elsewhere", lga="Other", group="Bandits", title="Some words entirely new", killed=30, kidnapped=200, day=-1, urls=["https://a.b/11"]),
        row(12, town="Far", lga="Remote", group="Nobody", title="Much later report", kidnapped=190, day=150, urls=["https://a.b/12"]),
        # An insertion, one that finds it by LGA and group, and one that finds it by town a day past that.
        row(20, state="Oyo", town="Ado", lga="Ado", urls=["https://a.b/20"]), row(21, state="Oyo", town="Iwo", lga="Ado", day=2, title="Other title words", urls=["https://a.b/21"]), row(22, state="Oyo", town="Ado", lga="Else", group="X", day=2, killed=3, title="Third title", urls=["https://a.b/22"]),
        # Another state's row gets an address from one report, by which the next one, of a town at the border, finds it.
        row(30, state="Kebbi", town="Bena", lga="Danko", group="Militia", day=-3, urls=["https://a.b/30"]), row(31, state="Niger", town="Bena", lga="Z", group="Y", title="Far from there", day=-3, urls=["https://A.B/30/"]),
        # Equal hashes, repeated rows' worth of them, and one without a town.
        *[row(40 + i, state="Kano", town="Rano", lga="Rano", killed=i, urls=[f"https://a.b/4{i}"]) for i in range(5)], row(50, state="Edo", town=None, lga="Q", urls=["https://a.b/50"]),
        # A state that is stored in another form: each of these is inserted, for the later does not find the earlier by its state.
        row(60, state="Delta State", town="Aba", lga="Aba", title="Alpha beta gamma", group="G1", urls=["https://a.b/60"]), row(61, state="Delta State", town="Aba", lga="Aba", title="Alpha beta gamma", group="G2", urls=["https://a.b/61"]),
    )
    return raw, ingest.with_hash(stored)


def test_chains_are_a_pass_in_order(spark):
    raw, stored = chains(spark)
    reports = rows_of(ingest.with_hash(raw))
    for r in reports:
        r["state_raw"] = r["state"]
    want, after = fold_with_states(reports, rows_of(stored))
    plan = settled(ingest.plan_in_order(raw, stored), "plan")
    assert {r.raw_id: (r.action, r.target) for r in plan.collect()} == want
    assert want[11] == ("merge", 1) and want[12] == ("merge_sources", 1) and want[21] == ("merge", 20) and want[31] == ("merge", 2) and want[61] == ("insert", None) and want[50] == ("error", None)
    once = settled(ingest.apply(raw, stored, F.lit(DAY), plan), "after")
    out = {r._id: r for r in once.collect()}
    assert set(out) == set(after)
    for i, w in after.items():
        assert (out[i].killed, out[i].kidnapped, [s.url for s in out[i].sources]) == (w["killed"], w["kidnapped"], [s["url"] for s in w["sources"]])
    again = {r._id: r for r in ingest.apply(raw, once, F.lit(DAY)).collect()}
    assert set(again) == set(out)


def fold_with_states(raw, stored):
    """fold() with the canonical state of insertions: here only "Delta State" differs from it."""
    acts, after = {}, [dict(s) for s in stored]
    for r in sorted(raw, key=lambda r: r["_id"]):
        one, rows = fold([r], after)
        acts |= one
        after = list(rows.values())
        if one[r["_id"]][0] == "insert":
            after[-1]["state"] = re.sub(" State$", "", r["state"])
    return acts, {s["_id"]: s for s in after}


def test_empty_batches_and_stores(spark):
    raw, stored = chains(spark)
    assert ingest.plan_in_order(raw.limit(0), stored).count() == 0
    want, _ = fold_with_states(rows_of(ingest.with_hash(raw)), [])
    assert {r.raw_id: (r.action, r.target) for r in ingest.plan_in_order(raw, stored.limit(0)).collect()} == want


def test_order_is_that_of_seq(spark):
    """With a column seq the batch is taken in its order, not in that of the ids."""
    raw, stored = chains(spark)
    turned = raw.withColumn("seq", -F.col("_id"))
    renamed = rows_of(ingest.with_hash(raw))
    ids = sorted((r["_id"] for r in renamed), reverse=True)
    back = {i: n for n, i in enumerate(ids)}
    # The fold goes by _id: rename the reports so that their order is turned, below and above the stored ids alike.
    want, _ = fold_with_states([{**r, "_id": 1000 + back[r["_id"]]} for r in renamed], rows_of(stored))
    name = {1000 + n: i for i, n in back.items()}
    got = {r.raw_id: (r.action, r.target) for r in ingest.plan_in_order(turned, stored).collect()}
    assert got == {name[i]: (a, name.get(t, t)) for i, (a, t) in want.items()}


def test_later_rounds_decide_what_changes_can_reach(spark, monkeypatch):
    """From the third round on only reports that a changed row can reach are decided anew, and the plan is that of a pass in order."""
    raw, stored = chains(spark)
    sizes, whole = [], ingest._decided

    def counted(hashed, *others, **named):
        sizes.append(hashed.count())
        return whole(hashed, *others, **named)

    monkeypatch.setattr(ingest, "_decided", counted)
    want, _ = fold_with_states(rows_of(ingest.with_hash(raw)), rows_of(stored))
    assert {r.raw_id: (r.action, r.target) for r in ingest.plan_in_order(raw, stored).collect()} == want
    assert sizes[:2] == [raw.count()] * 2 and len(sizes) > 2 and all(n < sizes[0] for n in sizes[2:])
