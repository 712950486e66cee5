"""Cross-state pairs compared by tiles are those of all pairs of rows, and rows of a place and day meet in blocks of bounded size."""

import random

from pyspark.sql import functions as F
from talus.functions.text import title_tokens
from talus.operators import dedup, tiles
from tests.test_operators import flat, row


def test_crossings_are_all_pairs(spark, monkeypatch):
    """One place's days of some 60 rows in blocks of five, so that most pairs lie across blocks; small groups share a bucket."""
    monkeypatch.setattr(tiles, "BLOCK", 5)
    monkeypatch.setattr(tiles, "BUCKET", 16)
    compared = tiles.crossing
    rnd = random.Random(5)
    words = "gunmen raid market village river camp troops seize convoy herders farm bridge".split()
    rows = [
        row(i, title=" ".join(rnd.sample(words, rnd.choice([0, 2, 4, 6]))), day=rnd.randrange(2), state=rnd.choice(["Kano", "kano", "Oyo", "Borno", None]), town=rnd.choice(["Wanka ", "wanka", "wanka", "Garga", "Unknown", f"Town {i}"]),
            killed=rnd.choice([None, 0, 99, 100, 250] if i % 7 == 0 else [None, 3]), urls=[f"https://a.b/story{rnd.randrange(25)}/" for _ in range(rnd.randrange(3))])
        for i in range(200)
    ]
    rows = flat(spark, *rows)

    def held(t, *rest):
        groups = t.group_by(["f_place", "f_day", "_i", "_j"]).aggregate([("_id", "count")])
        if max(groups.column("_id_count").to_pylist()) > 40:
            raise ValueError("a tile of too many rows")
        return compared(t, *rest)

    monkeypatch.setattr(tiles, "crossing", held)
    told = [r.asDict() for r in rows.withColumn("tokens", title_tokens("title")).select("_id", F.lower(F.trim("town")).alias("town"), F.to_date("date").alias("day"), F.lower("state").alias("state"), "killed", "tokens", F.transform("sources", lambda s: F.rtrim(F.lower(s["url"]), F.lit("/"))).alias("urls")).collect()]

    def met(a, b):
        tokens = len({*a["tokens"]} & {*b["tokens"]}) / (min(len(a["tokens"]), len(b["tokens"])) or 1) >= 0.7
        return tokens or bool(set(a["urls"] or []) & set(b["urls"] or [])) or min(a["killed"] or 0, b["killed"] or 0) >= 100

    known = [r for r in told if r["town"] != "unknown" and r["state"]]
    want = {(a["_id"], b["_id"]) for a in known for b in known if a["_id"] < b["_id"] and (a["town"], a["day"]) == (b["town"], b["day"]) and a["state"] != b["state"] and met(a, b)}
    got = [tuple(r) for r in dedup.cross_state_pairs(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_title_tokens_are_words_of_the_normalised_title(spark):
    titles = ["Nigeria: state-wide raid, NIGERIAN_troops", "  États nigerias  stated\tstate ", "", None, "x/y 1234 1234 attack_attacks", "İstanbul camp"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    from talus.functions import values as V
    from talus.functions.text import normalize_title

    long = F.array_distinct(F.filter(F.split(normalize_title("t"), " "), lambda w: (F.length(w) > 3) & ~w.isin(V.TITLE_OVERLAP_STOPWORDS)))
    for r in df.select(title_tokens("t").alias("got"), long.alias("want")).collect():
        assert r.got == r.want
