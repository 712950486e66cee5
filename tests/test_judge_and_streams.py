"""Questions asked by tasks, streams of candidates, limiters by event time, and the one-scan list."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from talus import catalog
from talus.operators import dedup, filters, judge
from talus.plans import views
from talus.sources import files
from talus.streaming import jobs

from .test_operators import DAY, flat, row

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_failures_are_tried_again_and_spoil_nothing(spark, tmp_path):
    marks = str(tmp_path)

    def ask(rows):
        # The first try of each batch fails; a row of its own always does; one batch gets too few answers.
        mark = f"{marks}/{rows[0]['id_a']}-{len(rows)}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise TimeoutError
        if any(r["id_a"] == 13 for r in rows):
            raise ValueError
        found = [{"is_duplicate": r["id_b"] % 2 == 0, "better": "existing"} for r in rows]
        return found[:-1] if any(r["id_a"] == 17 for r in rows) and len(rows) > 1 else found

    pairs = spark.createDataFrame([(i, 100 + i, 0.5, [i]) for i in range(20)], "id_a long, id_b long, score double, more array<int>").repartition(3)
    got = {r.id_a: r for r in judge.verdicts(pairs, ask, tries=2, together=4).collect()}
    assert len(got) == 20 and not got[13].answered and not got[13].is_duplicate and got[13].better == "candidate"
    assert all(r.answered and r.is_duplicate == (r.id_b % 2 == 0) and r.better == "existing" for i, r in got.items() if i not in (13,) and i not in bad(got))
    # Only what has no answer is asked again.
    known = judge.verdicts(pairs, ask, tries=1, together=50)
    known = files.settled(known, "verdicts")
    told = judge.verdicts(pairs, lambda rows: [{"is_duplicate": True, "better": None} for _ in rows], known=known)
    again = {r.id_a: r for r in told.collect()}
    assert len(again) == 20 and all(r.answered for r in again.values())
    assert {i for i, r in again.items() if r.better == "candidate"} == {r.id_a for r in known.where("NOT answered").collect()}
    assert judge.verdicts(pairs.limit(0), ask).count() == 0


def bad(got):
    """Rows asked alone for the first time, which fails here by design."""
    return {i for i, r in got.items() if not r.answered}


def test_reports_are_handed_on(spark):
    rows = flat(spark, row(1, title="A"), row(2, title="A"), row(3, title="B"))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a int, id_b int")
    got = judge.verdicts(pairs, lambda rows: [{"is_duplicate": r["a"]["title"] == r["b"]["title"], "better": "candidate"} for r in rows], reports=rows)
    assert {(r.id_a, r.id_b): r.is_duplicate for r in got.collect()} == {(1, 2): True, (1, 3): False}


@tables
def test_greedy_pairs_query(spark):
    rows = catalog.QUERIES["greedy_pairs"](spark, SF).collect()
    gone, want = set(), {}
    for r in sorted(rows, key=lambda r: (-r.score, r.id_a, r.id_b)):
        same = r.id_a % 11 != 0 and (r.id_a + r.id_b) % 3 != 0
        existing = r.id_a % 11 != 0 and r.id_b % 2 == 1
        want[r.id_a, r.id_b] = "skipped" if r.id_a in gone or r.id_b in gone else "merged" if same else "refused"
        if want[r.id_a, r.id_b] == "merged":
            gone.add(r.id_a if existing else r.id_b)
    assert {(r.id_a, r.id_b): r.outcome for r in rows} == want and len(rows) > 20 and set(want.values()) == {"merged", "refused", "skipped"}


def sliding(hits, width, limit):
    """Every hit, by a look at all allowed ones before it."""
    out, held = {}, {}
    for u, ts, e in sorted(hits):
        near = [t for t in held.get(u, []) if t > ts - dt.timedelta(seconds=width)]
        out[e] = len(near) < limit
        if out[e]:
            held.setdefault(u, []).append(ts)
    return out


@tables
def test_sliding_limit(spark):
    hits = [(r.user_id, r.ts, r.event_id) for r in views.load(spark, SF, "events").select("user_id", "ts", "event_id").collect()]
    want = sliding(hits, 86400, 2)
    assert {r.event_id: r.allowed for r in catalog.QUERIES["sliding_limit"](spark, SF).collect()} == want and len(set(want.values())) == 2


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_limiters_by_event_time(spark, tmp_path, rocks):
    """Hits out of order over several triggers give the answers of the table; state ends when the watermark has passed."""
    r = random.Random(3)
    hits = [(u, i * 4 + u, DAY + dt.timedelta(seconds=r.randrange(600))) for u in range(4) for i in range(25)]
    r.shuffle(hits)
    end = [(99, 9999, DAY + dt.timedelta(days=2))]
    schema = "user_id long, event_id long, ts timestamp"
    parts = [hits[i::4] for i in range(4)] + [end, [(99, 10000, DAY + dt.timedelta(days=4))]]
    src = str(tmp_path / "in")
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
    table = spark.createDataFrame(hits, schema)
    for name, steps in (("fixed", jobs.fixed_steps(60, 2)), ("sliding", jobs.sliding_steps(60, 2))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = jobs.limited_stream(stream, steps, 60, "20 minutes").writeStream.format("memory").queryName(f"by_{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(600) and q.exception() is None
        got = {x.event_id: (x.allowed, x.remaining) for x in spark.table(f"by_{name}").collect()}
        want = {x.event_id: (x.allowed, x.remaining) for x in jobs.limited(table, steps).collect()}
        assert {e: a for e, a in got.items() if e < 9999} == want and len({a for a, _ in want.values()}) == 2
    assert {e: a for e, (a, _) in got.items() if e < 9999} == sliding([(u, t, e) for u, e, t in hits], 60, 2)


def test_candidates_as_a_stream(spark, tmp_path):
    """Pairs of a stream with itself over several triggers are those of the table, and rows that no later one can meet leave the state."""
    rows = flat(spark, *[row(i, day=3 * i, killed=50 - i % 4, urls=[f"https://a.b/{i // 2}"]) for i in range(24)], row(50, day=0, state="Kano"), row(51, day=4, state=None))
    src = str(tmp_path / "in")
    for k in range(6):
        rows.where(f"_id >= {4 * k} AND _id < {4 * k + 4}" + (" OR _id >= 50" if k == 0 else "")).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = jobs.candidates(stream(), stream()).writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(900) and q.exception() is None
    want = {(r.id_a, r.id_b, r.score) for r in dedup.scan(rows).collect()}
    assert {(r.id_a, r.id_b, r.score) for r in spark.table("pairs").collect()} == want and len(want) > 20
    held = [sum(s.numRowsTotal for s in p.stateOperators) for p in q.recentProgress if p.stateOperators]
    assert max(held) < 2 * 24


def test_one_scan_gives_page_and_totals(spark, capsys):
    rows = flat(spark, *[row(i, day=-(i % 5), killed=i or None, deleted=i == 3 or None) for i in range(12)])
    for q in (filters.IncidentQuery(page=2, limit=5), filters.IncidentQuery(limit=3, sort="casualties-desc"), filters.IncidentQuery(page=9, limit=5), filters.IncidentQuery(state="Nowhere")):
        page, sums, meta = filters.envelope(rows, q)
        want = filters.totals(filters.where(rows, q)).first().asDict()
        assert {**sums, "total": meta["total"]} == want and page.schema == rows.schema
        assert [r._id for r in page.collect()] == [r._id for r in filters.page(rows, q).collect()]


def test_readers_of_answers_and_scans(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.txt").write_text('```json\n[{"title": "A", "location": {"state": "Kano"}}, {"title": "B", "location": {"state": "borno state"}}]\n```')
    (tmp_path / "a" / "2.txt").write_text("I found nothing.")
    assert sorted(r.title for r in files.read_answers(spark, str(tmp_path / "a")).collect()) == ["A", "B"]
    assert [r.title for r in files.read_answers(spark, str(tmp_path / "a"), ["BORNO"]).collect()] == ["B"]
    day = dt.date(2026, 1, 1)
    rows = [("in", "2026-01-14T23:00:00Z", "North", day), ("a day late", "2026-01-15T12:00:00Z", "North", day), ("two days late", "2026-01-16T12:00:00Z", "North", day), ("a day early", "2025-12-31T01:00:00Z", "North", day), ("not asked", "2026-01-02T00:00:00Z", "South", day), ("no date", "soon", "North", day)]
    files.write_periods(spark.createDataFrame(rows, "title string, date string, region string, first date"), str(tmp_path / "p"))
    grid = spark.createDataFrame([(day, dt.date(2026, 1, 14), "North")], "first date, last date, region string")
    assert sorted(r.title for r in files.read_periods(spark, str(tmp_path / "p"), grid).collect()) == ["a day early", "a day late", "in"]


def test_later_reports_without_a_window(spark, tmp_path):
    """A report months later finds its event in the store, whatever the stream's watermark."""
    from talus.operators import ingest
    from talus.sources.store import Store

    store = Store(str(tmp_path / "s"))
    store.create(ingest.with_hash(flat(spark, row(1, day=-300, kidnapped=200, urls=["https://a.b/one"]))).withColumn("updatedAt", F.col("createdAt")))
    reports = flat(spark, row(10, kidnapped=190, town="Elsewhere", lga="Off", group="X", urls=["https://a.b/ten"]), row(11, state="Kano", town="Rano", lga="Rano", urls=["https://a.b/kano"]))
    reports.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reports.schema).parquet(str(tmp_path / "in")).withWatermark("date", jobs.LATENESS)
    q = jobs.ingest(stream, jobs.into_store(store, "all", lambda: F.lit(DAY)), str(tmp_path / "c"))
    assert q.awaitTermination(600) and q.exception() is None
    got = {r._id: r for r in store.rows(spark).collect()}
    assert set(got) == {1, 11} and [s.url for s in got[1].sources] == ["https://a.b/one", "https://a.b/ten"] and got[1].kidnapped == 200


def test_whole_counts(spark):
    from talus.functions import text

    rows = spark.createDataFrame([(" 12 dead",), ("+3",), ("-4x",), ("about 5",), (None,), ("",), ("99999999999",), ("7.9",)], "t string")
    assert [r.n for r in rows.select(text.whole_count("t").alias("n")).collect()] == [12, 3, -4, None, None, None, None, 7]
