"""Matching where many reports meet many stored rows of a state and day: by what each clause goes by, not by all pairs."""

import random

from talus.operators import ingest
from tests.test_operators import flat, row


def test_places_inside_others(spark):
    """The pieces of held names give the same as looking into each: every length, repeats and empty names too."""
    rnd = random.Random(5)
    held = ["", "aaaa", "town"] + ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    names = ["a", "aa", "town", "abcabcabcabc"] + ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) for _ in range(40)]
    got = [tuple(r) for r in ingest._inside(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(h,) for h in [*held, None]], "h string")).select("name", "holder").collect()]
    assert len(got) == len(set(got)) and set(got) == {(n, h) for n in names for h in held if n in h}


def _plans(spark):
    rows = [row(i, state="Kano", day=i % 3, town=f"Wanka {i % 9}", lga="Anka", killed=i % 20, kidnapped=10 + i % 30) for i in range(60)]
    raw, stored = flat(spark, *rows[:20]), flat(spark, *rows[20:])
    return {f.__name__: f(raw, stored)._jdf.queryExecution() for f in (ingest.narrow_matches, ingest.broad_matches)}


def test_no_clause_meets_all_rows_of_a_day(spark):
    """F16: words of towns are no condition of a join of all rows of a state and day."""
    joins = [x for x in _plans(spark)["narrow_matches"].optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("exists(" in x for x in joins)


def test_the_driver_holds_no_growing_table(spark):
    """of what a follow-up meets, only the one row of lengths is broadcast."""
    text = _plans(spark)["broad_matches"].executedPlan().toString()
    assert text.count("BroadcastExchange") <= 1 and "BroadcastHashJoin" not in text


def test_towns_inside_longer_ones_are_followed_up(spark):
    """The oldest row counts whose town holds the report's, beside rows of the very town."""
    stored = flat(spark, row(5, day=0, town="Garga North", lga="Kanam", group="x"), row(6, day=1, town="Gargaru", lga="Kanam", group="x"), row(7, day=2, town="Garga", lga="Kanam", group="x"))
    raw = flat(spark, row(1, day=3, town="Garga", lga="Kanam"), row(2, day=3, town="Gargaru", lga="Kanam"))
    assert sorted(tuple(r) for r in ingest.broad_matches(raw, stored).collect()) == [(1, 5), (2, 6)]
