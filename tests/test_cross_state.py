"""Cross-state matches look at the first ten rows of other states, however many the own state has before them."""

from talus.operators import ingest
from tests.test_operators import flat, row


def test_first_ten_of_other_states(spark):
    stored, n = [], 0
    for state, count in (("Kano", 30), ("Oyo", 9), ("Kano", 5), ("Yobe", 12)):
        for _ in range(count):
            n += 1
            stored.append(row(n, state=state, day=0, urls=[f"https://a.b/{state}-{n}"]))
    # Of Kano's reports the tenth that is looked at is 45, the first of Yobe; 46 is the eleventh.
    raw = [row(100, state="Kano", urls=["https://a.b/Yobe-45"]), row(101, state="Kano", urls=["https://a.b/Yobe-46"]), row(102, state="Oyo", urls=["https://a.b/Kano-10"]), row(103, state="Oyo", urls=["https://a.b/Kano-11"]), row(104, state="Kano", day=1, urls=["https://a.b/Oyo-39"])]
    got = {r.raw_id: r.match_id for r in ingest.cross_state_matches(flat(spark, *raw), flat(spark, *stored)).collect()}
    assert got == {100: 45, 102: 10, 104: 39}


def test_rows_that_meet_reports_are_few(spark):
    stored = flat(spark, *[row(i, state=f"S{i % 3}") for i in range(300)])
    plan = ingest.cross_state_matches(flat(spark, row(900, state="Kano")), stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("dense_rank") >= 2
