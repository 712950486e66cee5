"""The best pairs without all others, and blocks of several widths."""

import pytest
from pyspark.sql import functions as F

from talus.operators import dedup, score, tiles

from .test_tiles import some


def test_best_pairs_are_those_of_all(spark, monkeypatch):
    """The best pairs, and those after them, told and untold, are the first of all pairs in order; tiles give few others."""
    monkeypatch.setattr(tiles, "BLOCK", 5)
    rows = some(spark, 120)
    want = sorted((tuple(r) for r in dedup.scan(rows, 0.4).collect()), key=lambda r: (-r[2], r[0], r[1]))
    assert len(want) > 60
    assert [tuple(r) for r in dedup.best(rows, 9, 0.4).collect()] == want[:9]
    a, b, s = want[8][:3]
    after = (round(100 * s), a, b)
    assert [tuple(r) for r in dedup.best(rows, 30, 0.4, told=False, after=after).collect()] == [r[:3] for r in want[9:39]]
    assert [tuple(r) for r in dedup.best(rows, len(want) + 5, 0.4, told=False).collect()] == [r[:3] for r in want]
    f = score.features(rows).withColumn("_new", F.lit(True)).withColumn("_kind", F.xxhash64(*dedup.KIND))
    kinds = f.select("_kind").distinct()
    apart = kinds.withColumnRenamed("_kind", "kind_x").crossJoin(kinds.withColumnRenamed("_kind", "kind_y")).withColumns({"s_location": F.lit(0.0), "s_group": F.lit(0.0)})
    assert tiles.pairs(f, apart, 8, 0.0, most=3).count() < tiles.pairs(f, apart, 8, 0.0).count() / 2


@pytest.mark.parametrize("tiles_wanted", [1e-9, 1e9])
def test_blocks_of_any_width_give_the_same_pairs(spark, monkeypatch, tiles_wanted):
    """Wide blocks deal a row to fewer tiles, and are compared by parts of BLOCK rows; the pairs stay those of the plain blocks."""
    rows = some(spark, 120)
    want = sorted(tuple(r) for r in dedup.scan(rows, 0.4, told=False).collect())
    monkeypatch.setattr(tiles, "BLOCK", 5)
    monkeypatch.setattr(tiles, "TILES", tiles_wanted)
    assert sorted(tuple(r) for r in dedup.scan(rows, 0.4, told=False).collect()) == want and len(want) > 60


def test_audit_with_a_limit_makes_no_other_pairs(spark, monkeypatch):
    """An audit with a limit brings the best pairs a few at a time, and asks about those that a look at all pairs, best first, would ask about."""
    rows = some(spark, 120)
    pairs = sorted((tuple(r) for r in dedup.scan(rows, 0.6, include_deleted=False).collect()), key=lambda r: (-r[2], r[0], r[1]))
    verdict = lambda a, b: ((a + b) % 3 != 0, "existing" if b % 2 else "candidate")
    gone, want = set(), []
    for a, b, *_ in pairs:
        if a in gone or b in gone or len(want) == 6:
            continue
        same, better = verdict(a, b)
        want.append((a, b, same))
        if same:
            gone.add(a if better == "existing" else b)
    monkeypatch.setattr(dedup, "scan", None)
    monkeypatch.setattr(dedup, "AHEAD", 1)
    report = dedup.audit(rows, lambda p: verdict(p["id_a"], p["id_b"]), limit=6, execute=True)[1].collect()
    assert [(r.id_a, r.id_b, r.is_duplicate) for r in report] == want and len(want) == 6
    assert [r.reason for r in report] == [dict(((a, b), r) for a, b, _, r in pairs)[x.id_a, x.id_b] for x in report]
