"""Pairs compared by tiles of blocks give what scoring each pair by itself gives."""

import datetime as dt
import random

import numpy as np

from pyspark.sql import functions as F
from tests.test_operators import DAY, flat, row
from talus.operators import dedup, score, tiles

WORDS = "gunmen raid market town village river camp road troops seize convoy herders farm bridge night school".split()


def some(spark, n):
    rnd = random.Random(7)
    told = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
    base = [told(6) for _ in range(12)]
    rows = []
    for i in range(n):
        title = base[i % 12] + rnd.choice(["", "s", " again", " in the far north of all"])
        rows.append(row(i, title=title, description=told(14), day=rnd.randrange(40), state=rnd.choice(["Kano", "Oyo", "kano state"]), town=rnd.choice(["Wanka", "Garga", "Gargaru", "Unknown"]), lga=rnd.choice(["Anka", "Unknown"]), group=rnd.choice(["Bandits", "herders"]), killed=rnd.choice([None, 0, 3, 8, 20]), urls=[f"https://a.b/story{rnd.randrange(30)}"]))
    return flat(spark, *rows)


def test_tiles_are_all_pairs(spark, monkeypatch):
    """Blocks of five rows, so that most pairs lie across blocks and days' buckets; threshold 0 keeps every pair."""
    monkeypatch.setattr(tiles, "BLOCK", 5)
    rows = some(spark, 150)
    f = score.features(rows)
    pairs = f.alias("a").join(f.alias("b"), (F.col("a.f_state") == F.col("b.f_state")) & (F.col("a._id") < F.col("b._id")) & (F.abs(F.unix_millis("a.date") - F.unix_millis("b.date")) <= 8 * 86_400_000))
    for threshold in (0.0, 0.6):
        want = {tuple(r) for r in dedup._scored(pairs, threshold).collect()}
        got = [tuple(r) for r in dedup.scan(rows, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        plain = [tuple(r) for r in dedup.scan(rows, threshold, told=False).collect()]
        assert len(plain) == len(want) and set(plain) == {r[:3] for r in want}
    since = DAY + dt.timedelta(days=30)
    late = {r._id for r in rows.where(F.col("createdAt") >= since).collect()}
    want = {tuple(r) for r in dedup._scored(pairs, 0.4).collect() if r.id_a in late or r.id_b in late}
    got = [tuple(r) for r in dedup.scan_recent(rows, F.lit(since), 0.4).collect()]
    assert len(got) == len(want) and set(got) == want


def test_texts_that_may_be_alike():
    """No pair within three tenths of edits is left out."""
    a, b = ["", "ab", "gunmen raid market town", "aaaaaaaaaa"], ["", "gunmen raided market town", "aaaaaaabbb", "zz", "gunmen raid market zzzz"]
    may = tiles._may_be_alike(a, b)
    assert may[0, 0] and may[2, 1] and may[2, 4] and may[3, 2] and not may[1, 3] and not may[2, 2]


def test_edits_of_all_pairs():
    """Distances of texts of any length, over one word of 64 characters and over several, are those of the plain table."""

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for k, d in enumerate(y, 1):
                row.append(min(last[k] + 1, row[-1] + 1, last[k - 1] + (c != d)))
        return row[-1]

    rnd = random.Random(3)
    texts = ["", "a", "é日本語", "a" * 64, "a" * 65, "b" * 130] + ["".join(rnd.choice("abcdé") for _ in range(rnd.choice([5, 40, 63, 64, 80, 127, 128, 150]))) for _ in range(24)]
    texts += [t[:20] + "xx" + t[25:] for t in texts]
    i, j = (x.reshape(-1) for x in np.indices((len(texts), len(texts))))
    assert tiles.edits(texts, texts[::-1], i, j).tolist() == [plain(texts[x], texts[::-1][y]) for x, y in zip(i, j)]


def test_pairs_below_the_threshold_stay_in_their_tile(spark):
    """Only pairs that reach the threshold leave the tiles: neither all pairs of a state nor their titles."""
    f = score.features(some(spark, 150)).withColumn("_new", F.lit(True)).withColumn("_kind", F.xxhash64(*dedup.KIND))
    kinds = f.select("_kind").distinct()
    apart = kinds.withColumnRenamed("_kind", "kind_x").crossJoin(kinds.withColumnRenamed("_kind", "kind_y")).withColumns({"s_location": F.lit(0.0), "s_group": F.lit(0.0)})
    got = tiles.pairs(f, apart, 8, 60 - 1e-6)
    assert set(got.columns) == {"id_x", "id_y", *tiles.BY_KIND, *tiles.PARTS}
    assert all(sum(r[p] for p in tiles.PARTS) >= 60 for r in got.collect())
