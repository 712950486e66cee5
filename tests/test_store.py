"""The versioned store: what a commit writes, and many writers at once."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from talus.operators import dedup, filters, ingest
from talus.sources.store import Store
from talus.streaming import jobs

from .test_operators import DAY, flat, row


def stored(spark, *rows):
    return ingest.with_hash(flat(spark, *rows)).withColumn("updatedAt", F.col("createdAt"))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def months(store, spark, version=None):
    return store.manifest(spark, version)["months"]


def test_commits_write_changed_months_alone(spark, tmp_path):
    """Inserting, updating and deleting write the months that change; older versions stay as they were."""
    store = Store(str(tmp_path / "s"))
    rows = stored(spark, *[row(i, day=-30 * (i % 6), state=f"State {i}") for i in range(30)])
    assert store.create(rows) == 0 and store.rows(spark).count() == 30
    before = months(store, spark)
    assert len(before) == 6
    # One row changes: one month is written, with its other rows.
    old = files(tmp_path / "s")
    changed = rows.where("_id = 7").withColumn("killed", F.lit(9))
    assert store.update(changed) == 1
    new = files(tmp_path / "s") - old
    assert {f.split("ym=")[1].split("/")[0] for f in new} == {changed.select(F.date_format("date", "yyyy-MM")).first()[0]} and spark.read.parquet(*new).count() == 5
    assert sum(before[m] != c for m, c in months(store, spark).items()) == 1
    # A row that moves from one month to another writes both.
    moved = rows.where("_id = 7").withColumn("date", F.lit(DAY))
    assert store.update(moved) == 2
    assert sum(months(store, spark, 1)[m] != c for m, c in months(store, spark).items()) == 2
    assert store.rows(spark).where("_id = 7").first().date == DAY and store.rows(spark).count() == 30
    # All rows of a month gone: the month goes too.
    last = min(before)
    assert store.delete(rows.where(F.date_format("date", "yyyy-MM") == last).select("_id")) == 3
    assert last not in months(store, spark) and store.rows(spark).count() == 25
    assert [store.rows(spark, v).count() for v in range(4)] == [30, 30, 30, 25] and store.rows(spark, 0).where("killed = 9").count() == 0
    # Nothing to change: nothing is written.
    old = files(tmp_path / "s")
    assert store.insert(rows.where("_id = 1")) == 3 and store.delete(rows.limit(0).select("_id")) == 4 and files(tmp_path / "s") == old
    with pytest.raises(ValueError):
        store.create(rows)


def test_rows_without_dates_and_empty_stores(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    rows = stored(spark, row(1), row(2, state="Kano"))
    store.create(rows.limit(0))
    assert store.rows(spark).count() == 0 and store.rows(spark).columns == rows.columns
    store.insert(rows.withColumn("date", F.when(F.col("_id") == 1, F.col("date"))))
    assert set(months(store, spark)) == {"2026-02", "none"} and sorted(r._id for r in store.rows(spark).collect()) == [1, 2]
    with pytest.raises(FileNotFoundError):
        Store(str(tmp_path / "none")).read(spark)


def test_date_filters_prune_months(spark, tmp_path, capsys):
    store = Store(str(tmp_path / "s"))
    store.create(stored(spark, *[row(i, day=-20 * i) for i in range(12)]))
    rows = store.read(spark)
    for q, held in ((filters.IncidentQuery(month="2026-01"), "(ym = 2026-01)|(ym#"), (filters.IncidentQuery(start=dt.datetime(2025, 12, 5), end=dt.datetime(2026, 1, 20)), ">= 2025-12")):
        found = filters.where(rows, q)
        found.explain()
        plan = capsys.readouterr().out
        scan = plan[plan.index("PartitionFilters") :].split("]")[0]
        assert "ym" in scan and any(h in scan for h in held.split("|"))
        want = filters.where(rows.drop("ym"), q)
        assert sorted(r._id for r in found.collect()) == sorted(r._id for r in want.collect()) != []
    one = filters.where(rows, filters.IncidentQuery(month="2026-01")).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("ym=")[1].split("/")[0] for r in one} == {"2026-01"}


def test_many_writers_lose_nothing(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    store.create(stored(spark, row(0)))
    failed = []

    def write(n):
        try:
            for k in range(3):
                store.insert(stored(spark, row(100 * n + k + 1, state=f"S{n}", town=f"T{k}"), row(1000 + 10 * n + k, state="Shared", town=f"T{k}")))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(1, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    rows = store.rows(spark).collect()
    # Nine of their own, and of the three that all insert one each.
    assert len(rows) == 1 + 9 + 3 and len({r.hash for r in rows}) == 13 and store.newest(spark) == 9


def landed(spark, path, rows):
    rows.coalesce(1).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def test_regions_and_a_sweep_on_one_store(spark, tmp_path):
    """Two regional streams and the duplicate sweep, started together, on one store: no report is lost, and a batch run again changes nothing."""
    store = Store(str(tmp_path / "s"))
    old = stored(spark, row(1, killed=50, urls=["https://a.b/one"]), row(2, killed=48, day=1, lga="Else", group="Gunmen", urls=["https://a.b/two"]), row(3, state="Borno", town="Konduga", lga="Konduga", urls=["https://a.b/three"]))
    store.create(old)
    reports = flat(
        spark, *[row(10 + i, state="Zamfara", town=f"Wide {i}", lga=f"Far {i}", group=f"G{i}", title=f"Alpha{i} beta{i} gamma{i}", urls=[f"https://a.b/z{i}"]) for i in range(4)],
        *[row(20 + i, state="Borno", town=f"Deep {i}", lga=f"Off {i}", group=f"G{i}", title=f"Delta{i} epsilon{i} zeta{i}", urls=[f"https://a.b/b{i}"]) for i in range(4)], row(30, state="Borno", town="Konduga", lga="Konduga", killed=7, day=1, urls=["https://a.b/more"]),
        row(40, state="Borno", day=400, town="Late", lga="Late", urls=["https://a.b/late"]),
    )
    stream = landed(spark, str(tmp_path / "in"), reports)
    in_time = jobs.in_scan(stream, F.lit(DAY - dt.timedelta(days=4)), F.lit(DAY + dt.timedelta(days=4)))
    now = lambda: F.lit(DAY)
    queries = jobs.ingest_regions(in_time, lambda region: jobs.into_store(store, region, now), str(tmp_path / "c"))
    queries.append(jobs.ingest(stream, jobs.sweep_into(store, "sweep", F.lit(DAY - dt.timedelta(days=5)), confirm=lambda p: ({p["id_a"], p["id_b"]} == {1, 2}, "candidate")), str(tmp_path / "c-sweep")))
    for q in queries:
        assert q.awaitTermination(600) and q.exception() is None
    rows = {r._id: r for r in store.rows(spark).collect()}
    assert set(rows) == {1, 3, *range(10, 14), *range(20, 24)}
    assert [s.url for s in rows[1].sources] == ["https://a.b/one", "https://a.b/two"] and (rows[3].killed, len(rows[3].sources)) == (7, 2)
    writers = store.manifest(spark)["writers"]
    assert {"Northwest", "Northeast", "sweep"} <= set(writers)
    version = store.newest(spark)
    jobs.into_store(store, "Northwest", now)(reports.where("state = 'Zamfara'"), writers["Northwest"])
    assert store.newest(spark) == version


def test_sweep_marks_or_deletes(spark, tmp_path):
    rows = stored(spark, row(1, killed=50, urls=["https://a.b/one"]), row(2, killed=48, day=1, urls=["https://a.b/two"]), row(3, killed=45, day=2, urls=["https://a.b/three"]), row(4, day=60, urls=["https://a.b/four"]))
    yes = lambda p: (True, "existing" if p["id_b"] == 3 else "candidate")
    for soft in (False, True):
        store = Store(str(tmp_path / f"s{soft}"))
        store.create(rows)
        jobs.sweep_into(store, "sweep", F.lit(DAY - dt.timedelta(days=5)), yes, most=None, soft=soft)(rows, 0)
        got = {r._id: r for r in store.rows(spark).collect()}
        alive = {i for i, r in got.items() if not r._deleted}
        # 1 takes 2 in, then goes into 3 with what it had.
        assert alive == {3, 4} and set(got) == ({1, 2, 3, 4} if soft else {3, 4}) and {s.url for s in got[3].sources} == {f"https://a.b/{n}" for n in ("one", "two", "three")}


def test_greedy_is_one_by_one(spark):
    """All pairs best first, for rules of many kinds, with ties, stars and chains."""
    import random

    r = random.Random(5)
    star = [(0, i, 0.9) for i in range(1, 40)]
    chain = [(i, i + 1, 0.5) for i in range(100, 125)]
    mixed = list({(a, b): (a, b, round(r.uniform(0.4, 1.2), 1)) for a, b in (sorted(r.sample(range(200, 230), 2)) for _ in range(150))}.values())
    pairs = [(a, b, s, r.random() < 0.8, r.choice(["existing", "candidate", None])) for a, b, s in star + chain + mixed]
    df = spark.createDataFrame(pairs, "id_a int, id_b int, score double, is_duplicate boolean, better string")
    gone, want, into = set(), {}, {}
    for a, b, s, same, better in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a in gone or b in gone:
            want[a, b] = "skipped"
            continue
        want[a, b] = "merged" if same else "refused"
        if same:
            kept, dropped = (b, a) if better == "existing" else (a, b)
            gone.add(dropped)
            into[dropped] = kept
    done = dedup.greedy(df)
    assert {(x.id_a, x.id_b): x.outcome for x in done.collect()} == want and set(want.values()) == {"merged", "refused", "skipped"}

    def end(x):
        while x in into:
            x = into[x]
        return x

    assert {x.dropped: x.kept for x in dedup.absorbed(done.where("outcome = 'merged'")).collect()} == {d: end(d) for d in into}
    assert dedup.greedy(df.limit(0)).count() == 0 and dedup.merged_pairs(df.limit(0), most=None).count() == 0
