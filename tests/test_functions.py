import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talus.functions import dates, text, urls
from talus.operators import classify, filters, merge, score, stats

NOON = dt.datetime(2026, 3, 3, 12)


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} {kind}" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_normalize_state(spark):
    cases = {"Borno State": "Borno", "abuja": "FCT", "Borno/Yobe": "Borno", "Borno and Yobe": "Borno", "cross_river": "Cross River", "nassarawa": "Nasarawa", "": "Unknown", "  ": "", "new place": "New place"}
    assert values(spark, text.normalize_state("c0"), list(cases)) == list(cases.values())


def test_states_match(spark):
    assert values(spark, text.states_match("c0", "c1"), [("Borno/Yobe", "Yobe"), ("Borno State", "borno"), ("", "Borno")]) == [True, True, False]


def test_similarity(spark):
    assert values(spark, text.similarity("c0", "c1"), [("", ""), ("abc", ""), ("kitten", "sitting")]) == [1.0, 0.0, pytest.approx(4 / 7)]


def test_town_overlap(spark):
    assert values(spark, text.towns_overlap("c0", "c1"), [("Garga (near Wanka)", "Wanka, Kyaram, Gyambau"), ("Dutsin Dan Ajiya (Tungan Dutse)", "Tungan Dutse"), ("", "x"), ("Anka", "Ankaa"), ("Jos", "Kano")]) == [True, True, False, True, False]


def test_unknown_place_and_sanitize(spark):
    assert values(spark, text.is_unknown_place("c0"), [None, "", "Unknown", "N/A", "unspecified", "Jos"]) == [True] * 5 + [False]
    assert values(spark, text.sanitize("c0"), ["${a}\u0001 ", "x" * 6000]) == ["a", "x" * 5000]


def test_keyword_overlap_of_empty(spark):
    assert values(spark, text.overlap(text.keywords("c0"), text.keywords("c1")), [("", "some words"), ("the of", "words"), ("gunmen kill five", "five dead, gunmen")]) == [0.0, 0.0, pytest.approx(2 / 3)]


# Values of the sample export: date, LGA, town, group, killed, hash prefix; the state is Zamfara.
EXPORT = [
    ("2026-02-19T00:00:00", "Anka", "Dutsin Dan Ajiya (Tungan Dutse)", "Bandits (Terrorists)", 50, "f0c1eaf16db6"),
    ("2026-02-19T23:59:59", "Anka", "Dutsin Dan Ajiya", "Bandits", 30, "382559c90ec4"),
    ("2026-02-20T00:00:00", "Unknown", "Unknown", "Bandits", 50, "ac6880a8b684"),
    ("2026-02-19T17:00:00", "Bukkuyum", "Tungan Dutse", "Armed Men (Bandits)", 50, "7284afd87719"),
    ("2026-02-17T00:00:00", "Unknown", "Magazu Village and Fadama area", "Bandits", 1, "80aac1e19e23"),
]


def export(spark):
    return spark.createDataFrame([(i, "Zamfara", *r[1:5], dt.datetime.fromisoformat(r[0]), r[5], "t", "d") for i, r in enumerate(EXPORT)], "_id int, state string, lga string, town string, group string, killed int, date timestamp, want string, title string, description string").withColumn("sources", F.array().cast("array<struct<url:string,title:string,publisher:string>>"))


def test_attack_hash(spark):
    got = export(spark).select("want", text.attack_hash(F.col("date"), "state", "lga", "town", "group").alias("h")).collect()
    assert all(r.h.startswith(r.want) for r in got)


def test_score_parts_of_the_export(spark):
    f = score.features(export(spark))
    p = score.parts()
    rows = f.alias("a").join(f.alias("b"), F.col("a._id") < F.col("b._id")).select(F.col("a._id").alias("i"), F.col("b._id").alias("j"), *[p[k].alias(k) for k in ("s_location", "s_group", "s_casualty", "s_date")]).collect()
    got = {(r.i, r.j): (round(r.s_location, 2), r.s_group, r.s_casualty, r.s_date) for r in rows}
    assert got == {
        (0, 1): (0.5, 0.15, 0.2, 0.1), (0, 2): (0, 0.15, 0.2, 0.05), (0, 3): (0.4, 0.15, 0.2, 0.1), (0, 4): (0, 0.15, 0, 0), (1, 2): (0, 0.15, 0.2, 0.1),
        (1, 3): (0, 0.15, 0.2, 0.1), (1, 4): (0, 0.15, 0, 0), (2, 3): (0, 0.15, 0.2, 0.1), (2, 4): (0, 0.15, 0, 0), (3, 4): (0, 0.15, 0, 0),
    }


def test_urls(spark):
    usable = {"https://x.ng/": False, "https://x.ng/ab": True, "ftp://x/abc": False, "https://x.ng/a.png": False, "https://www.google.com/search?q=1": False, "nope": False, None: False}
    assert values(spark, urls.is_usable_url("c0"), list(usable)) == list(usable.values())
    assert values(spark, urls.normalize_url("c0"), [" HTTPS://A.B/c/ ", "https://a.b//", None]) == ["https://a.b/c", "https://a.b/", ""]
    assert values(spark, urls.extract_domain("c0"), ["https://www.BBC.co.uk/x", "nope", None]) == ["bbc.co.uk", "", ""]
    trusted = [("https://punchng.com/a", ""), ("https://news.punchng.com/a", ""), ("https://a.com/b", "Punch"), ("https://punchng.com/youtube", ""), ("https://a.com/b", "Blog"), (None, None)]
    assert values(spark, urls.is_trusted_source("c0", "c1"), trusted) == [True, True, True, False, False, False]
    assert values(spark, urls.html_title("c0"), ["<title> A &amp;\n B</title>", "none", None]) == ["A & B", "", ""]


def test_dates(spark):
    cases = {
        "On March 3, 2026": NOON, "March 3 or 4, 2026": NOON, "Since 5 April 2026": dt.datetime(2026, 4, 5, 12), "March 3 2014": None,
        "February 30, 2026": dt.datetime(2026, 3, 2, 12), "on 7 May 2026 and March 1, 2026": dt.datetime(2026, 3, 1, 12), None: None, "": None,
    }
    assert values(spark, dates.narrative_date("c0"), list(cases)) == list(cases.values())
    assert values(spark, urls.url_date("c0"), ["https://a/2026/04/09/x", "https://a/2026-13-40/", None]) == [dt.datetime(2026, 4, 9, 12), None, None]
    page = '<script>{"datePublished": "2026-01-02T03:04:05Z"}</script><time datetime="2025-01-01">'
    assert values(spark, urls.published_date("c0", "c1"), [(page, "x"), ('<time class="a" datetime="2025-01-01">', "x"), ("", "https://a/2024/05/06/"), (None, None)]) == [dt.datetime(2026, 1, 2, 3, 4, 5), dt.datetime(2025, 1, 1), dt.datetime(2024, 5, 6, 12), None]
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    assert values(spark, dates.reconcile(F.col("c0"), F.col("c1")), [(day(0), day(n)) for n in (6, 7, 60, 61)], "timestamp") == [day(0), day(7), day(60), day(0)]


def test_date_lists(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    feb = one(dates.month_windows(F.lit(dt.date(2026, 2, 1)), F.lit(dt.date(2026, 6, 1))))
    assert [(w.first.day, w.last.day) if not callable(w.first) else (w["first"].day, w["last"].day) for w in feb] == [(1, 14), (15, 28)]
    assert [x.day for x in one(dates.anchor_dates(F.lit(dt.date(2026, 1, 1)), F.lit(dt.date(2026, 1, 10))))] == [10, 9, 5, 1]
    assert one(dates.month_options(F.lit(dt.date(2026, 1, 1)), F.lit(dt.date(2026, 3, 9)))) == ["2026-03", "2026-02", "2026-01"]


def test_counts(spark):
    assert values(spark, score.casualty_score(F.col("c0"), F.col("c1")), [(0, 0), (0, 5), (30, 50), (4, 10), (3, 10), (5, 10), (None, None)], "int") == [0.1, 0.05, 0.2, 0.1, 0.0, 0.1, 0.1]
    assert values(spark, merge.merge_count(F.col("c0"), F.col("c1")), [(None, None), (None, 0), (3, 5)], "int") == [None, 0, 5]
    assert values(spark, stats.intensity_bucket(F.col("c0")), [0.0, 0.7, 0.4, 0.15, 0.71, 1.0], "double") == ["muted", "ember", "caution", "safe", "urgent", "urgent"]


def test_json_array(spark):
    assert values(spark, urls.json_array("c0"), ['```json\n[{"a": 1}]\n```', "text [] end", "none", None]) == ['[{"a": 1}]\n', "[] end", "", ""]


def reports(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, description string, killed int, injured int, kidnapped int, displaced int")


def test_classifiers(spark):
    ops = reports(spark, [(t, "", None, None, None, None) for t in ("Troops rescue hostages", "Bandits kill villagers", "Police arrest gunmen", "Troops foil attack; soldiers killed")])
    assert [r.x for r in ops.select("i", classify.is_operational_update().alias("x")).orderBy("i").collect()] == [True, False, True, False]
    only = reports(spark, [("Troops neutralize 16 terrorists", "", None, None, None, None), ("ISWAP kills troops", "", 3, None, None, None), ("Soldiers killed in ambush", "", 2, None, None, None), ("Vigilance group killed 10 bandits", "", 10, None, None, None), ("Vigilance group killed 10 bandits", "", 16, None, None, None), ("Army freed 5 abducted", "", 2, None, None, None), (None, None, None, None, None, None)])
    assert [r.x for r in only.select("i", classify.attacker_only_reason().alias("x")).orderBy("i").collect()] == ["operation", None, None, "count", None, "rescue", None]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 2000), st.integers(1, 60))
def test_pagination(total, limit, page):
    p = filters.pagination(total, filters.IncidentQuery(page=page, limit=limit))
    assert p["totalPages"] == math.ceil(total / limit) and p["hasNext"] == (page * limit < total) and p["hasPrev"] == (page > 1)


@pytest.mark.parametrize("bad", [{"page": 0}, {"limit": 0}, {"limit": 2001}, {"sort": "x"}, {"status": "x"}, {"casualty_type": "displaced"}, {"month": "2026"}])
def test_bad_queries(bad):
    with pytest.raises(ValueError):
        filters.IncidentQuery(**bad)
