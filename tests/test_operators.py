import datetime as dt
import json

from pyspark.sql import functions as F

from talus import schema
from talus.operators import dedup, filters, ingest, merge, repair, stats
from talus.sources import files
from talus.streaming import jobs

FLAT = "_id int, title string, description string, date timestamp, state string, lga string, town string, group string, killed int, injured int, kidnapped int, displaced int, status string, _deleted boolean, createdAt timestamp, sources array<struct<url:string,title:string,publisher:string>>"
DAY = dt.datetime(2026, 2, 19)


def row(i, *, title="Gunmen raid market town", description="Gunmen came at night.", day=0, state="Zamfara", lga="Anka", town="Wanka", group="Bandits", killed=None, injured=None, kidnapped=None, status="unconfirmed", deleted=None, urls=()):
    date = DAY + dt.timedelta(days=day)
    return (i, title, description, date, state, lga, town, group, killed, injured, kidnapped, None, status, deleted, date, [(u, "", "Punch") for u in urls])


def flat(spark, *rows):
    return spark.createDataFrame(list(rows), FLAT)


def test_flatten_and_nest(spark):
    nested = spark.createDataFrame([], schema.INCIDENT_DDL)
    assert {f.name for f in schema.nest(schema.flatten(nested)).schema} == {f.name for f in nested.schema}


def test_valid(spark):
    rows = flat(spark, row(1), row(2, title=""), row(3, killed=-1), row(4, title="x" * 501), row(5, urls=[f"https://a.b/{i:03d}" for i in range(21)]))
    assert [r.ok for r in rows.select("_id", schema.valid(rows).alias("ok")).orderBy("_id").collect()] == [True, False, False, False, False]
    edge = flat(spark, row(1, title=" Raid5 "), row(2, title="Raid"), row(3, description="123456789"), row(4, state="x" * 101), row(5, lga="x" * 101), row(6, group="g" * 201), row(7, status="odd"), row(8, urls=["nope"]), row(9, urls=["https://a.b/" + "x" * 2000]), row(10, lga=None, town=None))
    assert [r.ok for r in edge.select("_id", schema.valid(edge).alias("ok")).orderBy("_id").collect()] == [True, *[False] * 8, True]


def test_envelope_and_pages(spark):
    rows = flat(spark, *[row(i, day=-(i % 5), killed=i or None, deleted=i == 3 or None) for i in range(12)])
    q = filters.IncidentQuery(page=2, limit=5)
    page, totals, meta = filters.envelope(rows, q)
    assert totals == {"killed": sum(range(12)) - 3, "injured": 0, "kidnapped": 0} and meta["totalPages"] == 3 and meta["hasNext"] and meta["hasPrev"]
    pages = [r._id for p in (1, 2, 3) for r in filters.page(rows, filters.IncidentQuery(page=p, limit=5)).collect()]
    assert pages == [r._id for r in filters.ordered(filters.where(rows, q), "date-desc").collect()] and len(pages) == 11


def test_merge_sources_and_pairs(spark):
    rows = flat(spark, row(1, killed=3, urls=["https://a.b/one/", "https://a.b/two"]), row(2, killed=5, urls=["HTTPS://A.B/ONE", "https://a.b/three", ""]), row(3, injured=1, status="confirmed", urls=["https://a.b/two/"]))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "kept int, dropped int")
    m = merge.merge_pairs(rows, pairs).first()
    assert (m.killed, m.injured, m.status) == (5, 1, "confirmed") and [s.url for s in m.sources] == ["https://a.b/one/", "https://a.b/two", "https://a.b/three"]
    after = repair.flag_groups(rows.withColumn("_deletedReason", F.lit("")), pairs)
    assert {r._id for r in after.where(schema.active()).collect()} == {1} and after.count() == 3
    assert {r._id for r in merge.hard_delete(rows, spark.createDataFrame([(2,)], "_id int")).collect()} == {1, 3}


def test_ingest_plan(spark):
    stored = ingest.with_hash(flat(
        spark, row(1, urls=["https://a.b/one"]), row(2, town="Jangebe", lga="Talata", day=-90, kidnapped=300, group="Unknown gunmen"),
        row(3, state="Kebbi", town="Bena", lga="Danko", killed=60, group="Militia"), row(4, town="Wanka", day=-200, deleted=True),
    ))
    raw = flat(
        spark, row(10), row(11, day=1, killed=9), row(12, town="Elsewhere", lga="Talata", day=0, kidnapped=310, group="Gunmen"), row(13, town="Bena", lga="X", day=1, killed=55, group="Other"),
        row(14, state="Kano", town="Rano", lga="Rano"), row(15, state="Kano", town="Rano", lga="Rano"), row(16, town=None, lga="Q", state="Oyo"),
    )
    got = {r.raw_id: (r.action, r.target) for r in ingest.plan(raw, stored).collect()}
    assert got == {10: ("merge", 1), 11: ("merge", 1), 12: ("merge_sources", 2), 13: ("merge", 3), 14: ("insert", None), 15: ("merge", 14), 16: ("error", None)}
    assert ingest.plan(raw.limit(0), stored).count() == 0


def test_scores_and_greedy(spark):
    rows = flat(spark, row(1, killed=50), row(2, killed=48, day=1), row(3, killed=45, day=2), row(4, day=20), row(5, state="Kano"))
    pairs = dedup.scan(rows)
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == {(1, 2), (1, 3), (2, 3)}
    assert dedup.scan_recent(rows, F.lit(DAY + dt.timedelta(days=2))).count() == 2
    assert dedup.process(pairs) == []  # without an answer no pair is a duplicate
    assert dedup.process(pairs, confirm=lambda p: (True, "candidate")) == [(1, 2), (1, 3)]
    assert dedup.process(pairs, confirm=lambda p: (True, "existing")) == [(2, 1), (3, 2)]
    assert dedup.process(pairs, confirm=lambda p: p["none"]) == []
    told = spark.createDataFrame([(1, 2, True, "existing"), (1, 3, False, None)], "id_a int, id_b int, is_duplicate boolean, better string")
    assert dedup.process(dedup.verdicts_of(pairs, told)) == [(2, 1)]
    assert {(r.id_a, r.id_b) for r in dedup.flattened(pairs, dedup.scan_state(rows, "zamfara state"), dedup.scan_state(rows, "Kano")).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_fix_and_recover_sources(spark):
    rows = flat(spark, row(1, urls=["https://a.b/good"]), row(2, urls=["https://a.b/good", "https://a.b/"]), row(3, urls=["ftp://x"]), row(4), row(5, urls=["nope"]))
    found = rows.where("_id = 5").select("_id", F.array(F.struct(F.lit("https://c.d/new").alias("url"), F.lit("").alias("title"), F.lit("P").alias("publisher"))).alias("sources"))
    got = {r._id: r.action for r in repair.fix_sources(rows, found).collect()}
    assert got == {1: "keep", 2: "prune", 3: "delete", 4: "delete", 5: "replace"}
    lost = rows.withColumns({"_deleted": F.lit(True), "_deletedReason": F.lit("Bad: no replacements found")})
    back = {r._id: r for r in repair.recover(lost, found).collect()}
    assert not back[5]._deleted and back[5].sources[0].url == "https://c.d/new" and back[1]._deleted
    assert {r.url: r.reason for r in repair.source_checks(rows).collect()}["https://a.b/"] == "homepage (no article path)"
    assert repair.counters(repair.fix_sources(rows, found)).first().asDict() == {"scanned": 5, "pruned": 1, "replaced": 1, "deleted": 2}


def test_export_and_reports(spark, tmp_path):
    p = tmp_path / "export.json"
    p.write_text(json.dumps([{"_id": {"$oid": "ab"}, "title": "T", "date": {"$date": "2026-02-19T00:00:00.000Z"}, "location": {"state": "Zamfara"}, "casualties": {"killed": 5}, "sources": []}]))
    r = files.read_export(spark, str(p)).first()
    assert (r._id, r.date, r.location.state, r.casualties.killed) == ("ab", DAY, "Zamfara", 5)
    answers = spark.createDataFrame([('```json\n[{"title": "A", "date": "2026-02-19T00:00:00Z", "casualties": {"killed": 2}}]```',), ("nothing",), (None,)], "text string")
    assert [(r.title, r.date, r.casualties.killed) for r in files.parse_reports(answers).collect()] == [("A", DAY, 2)]
    urls = spark.createDataFrame([("a",), ("b",)], "url string")
    assert {r.url for r in files.resolve_redirects(urls, spark.createDataFrame([("a", "z")], "url string, final_url string")).collect()} == {"z", "b"}
    seen, last = [], None
    while rows := files.keyset(flat(spark, *[row(i) for i in range(7)]), last, 3).collect():
        seen += [r._id for r in rows]
        last = seen[-1]
    assert seen == list(range(7))


def test_stats_on_empty(spark):
    rows = flat(spark)
    as_of = dt.datetime(2026, 3, 1)
    assert stats.overview(rows, as_of).first().total_killed == 0
    assert [r.incidents for r in stats.by_month(rows, as_of).collect()] == [0, 0, 0]
    assert stats.map_by_state(rows, stats.state_dim(spark)).count() == 37


def test_fixed_window(spark):
    hits = spark.createDataFrame([(1, i, DAY + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 61, 62))], "user_id long, event_id long, ts timestamp")
    assert [r.allowed for r in jobs.fixed_window(hits, 60, 2).orderBy("event_id").collect()] == [True, True, False, True, True]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    hits = spark.createDataFrame([(1, i, DAY + dt.timedelta(seconds=s), "a", 1.0) for i, s in enumerate((0, 10, 20, 61))], "user_id long, event_id long, ts timestamp, event_type string, value double")
    hits.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(hits.schema).parquet(src)
    jobs.ingest(stream, lambda df, n: out.append((n, df.count())), str(tmp_path / "c1")).awaitTermination(120)
    assert out == [(0, 4)]
    q = jobs.fixed_window_stream(stream, 60, 2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert [r.allowed for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, False, True]
    reports = hits.withColumns({"date": F.col("ts"), "hash": (F.col("event_id") % 2).cast("string")})
    reports.coalesce(1).write.parquet(str(tmp_path / "r"))
    d = jobs.in_window(spark.readStream.schema(reports.schema).parquet(str(tmp_path / "r"))).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    d.awaitTermination(120)
    assert spark.table("once").count() == 2
    assert jobs.sliding_counts(hits).count() >= 3


def test_scan_grid(spark):
    from talus.functions.dates import month_windows

    grid = repair.scan_grid(spark, [month_windows(F.lit(dt.date(2026, m, 1)), F.lit(dt.date(2026, 6, 1))) for m in (1, 2)])
    assert grid.count() == 5 * 6


def test_threshold_is_compared_before_rounding(spark):
    """Parts that add up to 0.39999999999999997 are shown as 0.40 and are no candidate."""
    rows = flat(spark, row(1, title="alpha", description="x", town="Unknown", lga="Unknown", group="herders", killed=50), row(2, title="omega", description="y", town="Unknown", lga="Unknown", group="herders", killed=40, day=1))
    pairs = dedup.scan(rows, threshold=0.0).collect()
    assert pairs[0].score == 0.4 and pairs[0].reason == "Score: 0.40 (Loc: 0.00 [location-unknown], Grp: 0.15, Cas: 0.20 [50v40], Title: 0.00 [kw:0.00, sim:0.20+0.00], Desc: 0.00 [0.00], Src: 0.00, Date: 0.05)"
    raw = 0.0 + 0.0 + 0.15 + 0.2 + 0.0 + 0.0 + 0.0 + 0.0 + 0.05
    assert (dedup.scan(rows).count() == 1) == (raw >= 0.4)


def test_reason_tells_how_places_met(spark):
    pairs = {(1, 2): ("Wanka", "Anka", "Wanka town", "Anka", "town-match(alias)"), (3, 4): ("Garga", "Anka", "Gurgo", "Anka", "town-partial(0.60)"), (5, 6): ("Unknown", "Anka", "Wanka", "Anka", "lga-match(1.00)"), (7, 8): ("Aaaa", "Kanamma", "Zzzz", "Kanamma", "lga-fallback(1.00)"), (9, 10): ("Aaaa", "Bbbb", "Zzzz", "Cccc", "")}
    rows = [r for (a, b), (t1, l1, t2, l2, _) in pairs.items() for r in (row(a, town=t1, lga=l1, state=f"S{a}"), row(b, town=t2, lga=l2, state=f"S{a}"))]
    got = {(r.id_a, r.id_b): r.reason for r in dedup.scan(flat(spark, *rows), threshold=0.0).collect()}
    assert {k: v.split("[")[1].split("]")[0] for k, v in got.items()} == {k: v[4] for k, v in pairs.items()}


def test_audit_is_brute_force(spark):
    """Pairs best first, one by one; merged ones take no part any more, but only when the audit executes."""
    rows = flat(spark, *[row(i, killed=50 - i, day=i % 3, urls=[f"https://a.b/story{i}"]) for i in range(6)]).withColumn("_deletedReason", F.lit(""))
    rule = lambda p: ((p["id_a"] + p["id_b"]) % 2 == 1, "existing" if p["id_b"] % 3 == 0 else "candidate")
    ordered = [(r.id_a, r.id_b) for r in dedup.scan(rows, 0.6, include_deleted=False).orderBy(F.desc("score"), "id_a", "id_b").collect()]
    for execute in (False, True):
        gone, want, into = set(), [], {}
        for a, b in ordered:
            if len(want) == 4:
                break
            if a in gone or b in gone:
                continue
            same, better = rule({"id_a": a, "id_b": b})
            kept, dropped = (b, a) if better == "existing" else (a, b)
            want.append((a, b, same))
            if same and execute:
                gone.add(dropped)
                into[dropped] = kept
        after, report = dedup.audit(rows, rule, threshold=0.6, limit=4, execute=execute)
        assert [(r.id_a, r.id_b, r.is_duplicate) for r in report.collect()] == want
        assert {r._id for r in after.where("_deleted").collect()} == gone
        for r in after.where(schema.active()).collect():
            assert len(r.sources) == 1 + sum(1 for x in into if _root(x, into) == r._id)


def _root(x, into):
    while x in into:
        x = into[x]
    return x


def test_batches_are_applied(spark):
    """Merges, later reports, inserts and errors change the stored table; the same batch again inserts nothing."""
    stored = ingest.with_hash(flat(
        spark, row(1, killed=3, urls=["https://a.b/one"]), row(2, town="Jangebe", lga="Talata", day=-90, kidnapped=300, group="Unknown gunmen", urls=["https://a.b/two"]), row(3, state="Kano", town="Gaya", lga="Gaya", title="Herders burn two farms", group="Herders"),
    ))
    raw = flat(
        spark, row(10, killed=9, status="confirmed", urls=["https://a.b/ONE/", "https://a.b/ten"]), row(12, town="Elsewhere", lga="Talata", day=0, kidnapped=310, group="Gunmen", urls=["https://a.b/twelve"]),
        row(14, state="Kano State", town="Rano", lga="Rano", title="A ${raid} in Rano", urls=["https://a.b/x1"]), row(15, state="Kano", town="Rano", lga="Rano", killed=7, urls=["https://a.b/x2"]), row(16, town=None, lga="Q", state="Oyo", urls=["https://a.b/x3"]), row(17, state="Oyo", town="Oyo", urls=["nope"]),
    )
    now = F.lit(DAY)
    once = ingest.apply(raw, stored, now)
    got = {r._id: r for r in once.collect()}
    assert set(got) == {1, 2, 3, 14}
    assert (got[1].killed, got[1].status, [s.url for s in got[1].sources]) == (9, "confirmed", ["https://a.b/one", "https://a.b/ten"])
    assert (got[2].kidnapped, [s.url for s in got[2].sources]) == (300, ["https://a.b/two", "https://a.b/twelve"])
    assert (got[14].state, got[14].title, got[14].killed, [s.url for s in got[14].sources]) == ("Kano", "A raid in Rano", 7, ["https://a.b/x1", "https://a.b/x2"])
    assert len({r.hash for r in got.values()}) == 4


def test_reports_are_made_ready(spark):
    """Trust, fields, operational updates, windows, repeated sources, redirects, pages and their age, one rule at a time."""
    schema_ = "_id int, title string, description string, date timestamp, state string, lga string, town string, group string, sources array<struct<url:string,title:string,publisher:string>>"
    good = ("https://punchng.com/bandits-wanka", "Bandits attack Wanka town", "Punch")
    make = lambda i, *sources, title="Bandits raid Wanka town", description="Farmers were killed there.", day=0, state="zamfara state": (i, title, description, DAY + dt.timedelta(days=day), state, "Anka", "Wanka", "Bandits", list(sources))
    redirect = lambda n: (f"https://v.g/grounding-api-redirect/{n}", "Wanka bandits", "Punch")
    rows = [
        make(1, good, good, ("https://punchng.com/wanka-2", "Wanka: bandits strike", "Punch")), make(2, ("https://blog.xyz/abc", "t", "Local blog")), make(3, good, title=""), make(4, good, title="Troops rescue hostages", description="Operation in the forest."), make(5, good, day=50),
        make(6, redirect(1)), make(7, redirect(2)), make(8, ("https://punchng.com/football", "Wanka bandits", "Punch")), make(9, ("https://punchng.com/old-wanka-bandits", "t", "Punch")), make(10, good, description="On January 30, 2026 bandits came."),
        make(11, *[(f"https://punchng.com/bandits-wanka-{k}", "Bandits in Wanka", "Punch") for k in range(5)]),
    ]
    raw = spark.createDataFrame(rows, schema_)
    redirects = spark.createDataFrame([("https://v.g/grounding-api-redirect/1", "https://punchng.com/wanka-bandits-real")], "url string, final_url string")
    pages = spark.createDataFrame([
        ("https://punchng.com/football", None, "<title>League results</title>"), ("https://punchng.com/old-wanka-bandits", None, '<title>Bandits raid Wanka</title><script>"datePublished": "2025-12-01T00:00:00Z"</script>'),
        ("https://punchng.com/wanka-2", "https://punchng.com/wanka-2-final", "<title>Bandits raid Wanka &amp; around</title>"),
    ], "url string, final_url string, html string")
    done = {r._id: r for r in ingest.normalized(raw, F.lit(DAY - dt.timedelta(days=30)), F.lit(DAY + dt.timedelta(days=2)), redirects, pages).collect()}
    assert set(done) == {1, 6, 10, 11}
    assert done[1].state == "Zamfara" and [(s.url, s.title) for s in done[1].sources] == [(good[0], good[1]), ("https://punchng.com/wanka-2-final", "Bandits raid Wanka & around")]
    assert [s.url for s in done[6].sources] == ["https://punchng.com/wanka-bandits-real"] and done[10].date == dt.datetime(2026, 1, 30, 12) and len(done[11].sources) == 3


def test_chunk_tiers(spark):
    """One report for each tier of the address rule, and the two simpler rules."""
    schema_ = "_id int, title string, description string, state string, lga string, town string, group string, sources array<struct<url:string,title:string,publisher:string>>"
    red = "https://v.g/grounding-api-redirect/1"
    make = lambda i, title, publisher, url=red: (i, "Bandits raid Wanka market", "Traders fled.", "Zamfara", "Anka", "Wanka", "Bandits", [(url, title, publisher)])
    raw = spark.createDataFrame([make(1, "Wanka market raid deaths", "Nobody"), make(2, "zzz", "Daily Trust desk"), make(3, "zzz", "Nobody"), make(4, "zzz", "Nobody"), make(5, "zzz", "Nobody"), make(6, "zzz", "Nobody", "https://keep.me/abc")], schema_)
    chunks = spark.createDataFrame([
        (1, 0, "https://a.b/none", "other thing"), (1, 1, "https://a.b/best", "Wanka market raid deaths rise"), (2, 0, "https://a.b/none", "other thing"), (2, 1, "https://news.dailytrust.com/x", "unrelated story here"),
        (3, 0, "https://reuters.com/sport", "football results"), (3, 1, "https://reuters.com/wanka", "Wanka market burns"), (4, 0, "https://a.b/none", "other thing"), (4, 1, "https://bbc.com/sport", "football results"), (5, 0, "https://a.b/none", "other thing"), (6, 0, "https://a.b/best", "Wanka market raid"),
    ], "raw_id int, pos int, uri string, title string")
    url = lambda df: {r._id: r.sources[0].url for r in df.collect()}
    assert url(ingest.chunk_addresses(raw, chunks)) == {1: "https://a.b/best", 2: "https://news.dailytrust.com/x", 3: "https://reuters.com/wanka", 4: "https://bbc.com/sport", 5: red, 6: "https://keep.me/abc"}
    assert url(ingest.gap_chunk_addresses(raw, chunks)) == {1: "https://a.b/best", 2: "", 3: "https://reuters.com/wanka", 4: "", 5: "", 6: "https://keep.me/abc"}
    assert url(ingest.title_chunk_addresses(raw, chunks)) == {1: "https://a.b/best", **{i: "https://www.google.com/search?q=Bandits%20raid%20Wanka%20market" for i in (2, 3, 4, 5)}, 6: "https://keep.me/abc"}


def test_quality_repair(spark):
    rows = flat(
        spark, row(1, title="Raid in Wanka", urls=["https://a.b/1", "https://a.b/2"]), row(2, title="Raid in Wanka, Nigeria", killed=4), row(3, state="Kebbi", town="Wanka", title="Other words entirely", urls=["https://a.b/1"]),
        row(4, town="Far", title="Lone", description="On March 1, 2026 it began.", day=-1), row(5, day=60, title="Raid in Wanka"),
    ).withColumn("_deletedReason", F.lit(None).cast("string"))
    after, done = repair.repair_quality(rows, F.lit(DAY - dt.timedelta(days=20)), F.lit(DAY + dt.timedelta(days=20)))
    got = {r._id: r for r in after.collect()}
    assert sorted((r.step, r._id, r.kept) for r in done.collect()) == [("cross-state", 3, 1), ("date", 4, None), ("exact", 2, 1)]
    assert got[1].killed == 4 and got[2]._deletedReason == "Exact duplicate of 1" and got[3]._deletedReason == "Cross-state duplicate of 1" and got[3]._deleted and not got[5]._deleted
    assert got[4].date == dt.datetime(2026, 3, 1, 12)


def test_inserts_are_idempotent(spark, tmp_path):
    rows = ingest.with_hash(flat(spark, row(1), row(2), row(3, state="Kano"))).withColumns({"coordinates": F.lit(None).cast("struct<lat:double,lng:double>"), "tags": F.array().cast("array<string>"), "_deletedReason": F.lit(""), "updatedAt": F.col("createdAt"), "_id": F.col("_id").cast("string")})
    nested = schema.nest(rows)
    schema.write_incidents(nested.limit(0), str(tmp_path / "t"))
    for _ in range(2):
        schema.insert_incidents(nested, str(tmp_path / "t"))
        assert sorted(r._id for r in schema.read_incidents(spark, str(tmp_path / "t")).collect()) == ["1", "3"]


def test_small_forms(spark, tmp_path):
    answers = spark.createDataFrame([("prose [1] and more",), ('```JSON\n[{"title": "A"}]```',), ("nothing",)], "text string")
    assert [r.title for r in files.parse_reports(answers, lenient=True).where("title IS NOT NULL").collect()] == ["A"]
    files.write_report(flat(spark, row(1)).select("_id", "title", "sources"), str(tmp_path / "text"), "text")
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["_id: 1", "title: Gunmen raid market town", "sources: []", ""]
    rows = flat(spark, row(1), row(2, title="The general spoke"))
    assert repair.first_matching(rows, F.contains("title", F.lit("general")), "_id").first()._id == 2 and repair.first_matching(rows, F.contains("title", F.lit("none")), "_id").first()._id == 1
    after = repair.backfill(rows.limit(1).withColumn("updatedAt", F.col("createdAt")), [flat(spark, row(10, state="Kano", town="Rano", urls=["https://a.b/ab"])), flat(spark, row(11, state="Kano", town="Rano", urls=["https://a.b/cd"]))], F.lit(DAY))
    assert {r._id: len(r.sources) for r in after.collect()} == {1: 0, 10: 2}
