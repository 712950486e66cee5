"""Matching of raw reports with stored incidents, and ingestion as one set-based plan."""

from __future__ import annotations

import datetime as dt
import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.dates import narrative_date, reconcile
from ..functions.text import any_of, attack_hash, bound, normalize_state, sanitize, text, tokenize
from ..functions.urls import chunk_score, extract_domain, html_title, is_trusted_source, is_usable_url, location_tokens, normalize_url, published_date, root_domain, semantic_tokens, shared_words, source_relevant
from ..schema import CASUALTIES, active
from ..sources.files import settled
from .classify import is_operational_update
from .merge import merge_count, merge_sources, new_sources, upsert

# Words that say nothing in a title.
TITLE_STOPWORDS = [
    "attack", "attacks", "kill", "kills", "killed", "gunmen", "armed", "village", "bandits", "dead", "soldiers", "police", "troops", "people", "residents", "suspected", "abducted", "kidnapped",
    "shooting", "open", "fire", "shot", "farmers", "worshippers",
]
TOWN_STOPWORDS = ["near", "and", "the", "from", "area"]


def _same(a: str, b: str) -> Column:
    return F.lower(F.col(a)) == F.lower(F.col(b))


def _words(c: str, least: int, stop: list[str]) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(stop))


def _within(value: Column, of: Column, low: float, high: float) -> Column:
    return (value >= F.floor(of * low)) & (value <= F.ceil(of * high))


def _seen(raw: str = "r", stored: str = "s", versioned: bool = True) -> Column:
    """Whether a version of a stored row is the one that a report finds when its turn comes: made by an earlier report, and not yet replaced."""
    if not versioned:
        return F.lit(True)
    seq, since, until = F.col(f"{raw}.seq"), F.col(f"{stored}.since"), F.col(f"{stored}.until")
    return (since.isNull() | (since < seq)) & (until.isNull() | (seq <= until))


def narrow_matches(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """(raw_id, match_id): the first stored row (by createdAt, _id) within two days in the same state that one of six clauses ties to a raw one.

    Each clause is an equality of state, day and what it goes by: stored rows are reduced to the first of each such key, and a raw row asks
    for the keys of its five days. Towns that hold a word, counts within a range and titles that hold all words are found once for each
    different question of a day. Stored rows may be versions (since, until) of which a raw row sees the one of its turn (seq).
    """
    versioned = "since" in stored.columns
    when, turn = (["since", "until"], ["seq"]) if versioned else ([], [])
    low = lambda c: F.lower(F.col(c)).alias(c)
    day, age = F.col("date").cast("date"), ["createdAt", *(["turn"] if "turn" in stored.columns else []), "_id"]
    s = settled(stored.select(day.alias("d"), low("state"), low("lga"), low("town"), low("group"), low("title"), "killed", "kidnapped", F.struct(*age).alias("first"), *when), "stored-near")
    nlga = F.lower(F.when(text("lga") == "", "Unknown").otherwise(F.col("lga"))).alias("lga")
    r = settled(raw.select("_id", day.alias("day"), low("state"), nlga, low("town"), low("group"), "killed", "kidnapped", F.array_distinct(_words("town", 3, TOWN_STOPWORDS)).alias("tw"), F.slice(_words("title", 4, TITLE_STOPWORDS), 1, 3).alias("hw"), *turn), "reports-near")
    first, days = F.min("first").alias("first"), F.explode(F.sequence(F.date_sub("day", 2), F.date_add("day", 2))).alias("d")

    def found(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
        have = held.groupBy("state", "d", *keys, *when).agg(first).alias("s")
        asked = rows.select("_id", "state", days, *keys, *turn).alias("r")
        on = _all([F.col(f"r.{c}") == F.col(f"s.{c}") for c in ["state", "d", *keys]]) & _seen(versioned=versioned)
        return asked.join(have.hint("merge"), on).select("r._id", "s.first")

    def asked(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.select("state", days, *keys).distinct()

    words = r.select("_id", "state", "day", "lga", F.explode("tw").alias("word"), *turn)
    inside = _inside(words.select("word"), s.select("town"))
    counted = r.where("killed > 0").withColumn("k", F.col("killed")).drop("killed")
    counts = s.groupBy("state", "d", "lga", "killed", *when).agg(first)
    near = asked(counted, ["lga", "k"]).join(counts.hint("merge"), ["state", "d", "lga"]).where(_within(F.col("killed"), F.col("k"), 0.5, 1.5))
    titled = r.where("size(hw) >= 2")
    told = asked(titled, ["group", "hw"]).join(s.select("state", "d", "group", "title", "first", *when).hint("merge"), ["state", "d", "group"]).where(F.forall("hw", lambda w: F.contains("title", w)))
    steps = [
        found(r, s, ["town"]),
        found(words, s.join(inside.hint("merge"), F.col("town") == F.col("holder")).withColumnRenamed("name", "word"), ["lga", "word"]),
        found(r, s, ["lga", "group"]),
        found(counted, near, ["lga", "k"]),
        found(titled, told, ["group", "hw"]),
        found(r.where("killed > 0 AND kidnapped > 0"), s, ["group", "killed", "kidnapped"]),
    ]
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    return every.groupBy(F.col("_id").alias("raw_id")).agg(first).select("raw_id", F.col("first._id").alias("match_id"))


def _age(stored: DataFrame) -> list[Column]:
    """The order in which stored rows (alias s) came: by createdAt, insertions of a batch by their turn, then by _id."""
    return [F.col(c) for c in ("s.createdAt", *(["s.turn"] if "turn" in stored.columns else []), "s._id")]


def _known(c: str) -> Column:
    return (F.trim(text(c)) != "") & (F.lower(F.trim(text(c))) != "unknown")


def broad_matches(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """(raw_id, match_id) of later reports: see _followed_up()."""
    return _followed_up(raw, stored).select("raw_id", "match_id")


def _followed_up(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """(raw_id, match_id, match_date): the oldest active stored row of the state that is the same event reported later, by clauses of place and scale.

    Only the oldest counts, so stored rows are reduced to the oldest of each place and count, of each town's name, and of each town,
    group and time before they meet a report; reports that ask the same are asked for once. What a join makes grows with
    the different places, names and counts, not with the rows of a state. Nothing is broadcast: files are small beside what they are in memory,
    and the driver would hold the tables of several joins at once.
    """
    versioned = "since" in stored.columns
    when, turn = (["since", "until"], ["seq"]) if versioned else ([], [])
    low = lambda c: F.lower(F.col(c)).alias(c)
    bare = lambda c: F.lower(F.trim(F.col(c))).alias(c)
    s = settled(stored.where(active()).select("_id", "date", low("state"), low("lga"), low("town"), low("group"), "kidnapped", *when), "followed-up")
    r = settled(raw.select("_id", "date", low("state"), bare("lga"), bare("town"), low("group"), "kidnapped", _known("lga").alias("kl"), _known("town").alias("kt"), *turn), "follow-ups")
    oldest = F.min(F.struct("date", "_id")).alias("oldest")
    # A count and one within the factor 1.2 ^ reach of it are at most so many buckets of a logarithm to the base 1.2 apart.
    bucket = F.floor(F.log(F.col("kidnapped").cast("double")) / F.log(F.lit(1.2)))

    def by_count(rows: DataFrame, place: list[str], reach: int, low: float, high: float) -> DataFrame:
        have = s.where("kidnapped > 0").groupBy(*place, "kidnapped", *when).agg(oldest).withColumn("kb", bucket).alias("s")
        asked = rows.select(*place, "kidnapped", *turn).distinct().withColumn("kb", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda i: i + bucket))).alias("r")
        on = [F.col(f"r.{c}") == F.col(f"s.{c}") for c in [*place, "kb"]]
        near = asked.join(have.hint("merge"), _all(on)).where(_within(F.col("s.kidnapped"), F.col("r.kidnapped"), low, high) & _seen(versioned=versioned))
        found = near.groupBy(*[F.col(f"r.{c}").alias(c) for c in [*place, "kidnapped", *turn]]).agg(F.min("s.oldest").alias("oldest"))
        return rows.join(found.hint("merge"), [*place, "kidnapped", *turn]).select("_id", "oldest")

    def by_name() -> DataFrame:
        asked = r.where("kl AND kt").select("_id", "state", "lga", "town", *turn).alias("r")
        held = s.where("lga IS NOT NULL").groupBy("state", "lga", "town", *when).agg(oldest)
        have = held.join(_inside(asked.select("town"), held.select("town")).hint("merge"), F.col("town") == F.col("holder")).groupBy("state", "lga", "name", *when).agg(F.min("oldest").alias("oldest")).alias("s")
        on = _all([F.col("r.state") == F.col("s.state"), F.col("r.lga") == F.col("s.lga"), F.col("r.town") == F.col("s.name")]) & _seen(versioned=versioned)
        return asked.join(have.hint("merge"), on).select("r._id", "s.oldest")

    def by_town() -> DataFrame:
        # Both sides of 60 days are three buckets of as many; a bucket holds each time of a town and group once.
        days = F.floor(F.unix_millis("date") / (60 * 86_400_000))
        have = s.groupBy("state", "town", "group", "date", *when).agg(oldest).withColumn("b", days).alias("s")
        told = r.where("kt").where(~F.trim(text("group")).isin([*V.UNKNOWN_GROUPS, ""]))
        asked = told.select("state", "town", "group", "date", *turn).distinct().withColumn("b", F.explode(F.array(days - 1, days, days + 1))).alias("r")
        apart = F.abs(F.unix_millis("s.date") - F.unix_millis("r.date")) <= 60 * 86_400_000
        near = asked.join(have.hint("merge"), _all([F.col(f"r.{c}") == F.col(f"s.{c}") for c in ("state", "town", "group", "b")])).where(apart & _seen(versioned=versioned))
        found = near.groupBy(*[F.col(f"r.{c}").alias(c) for c in ["state", "town", "group", "date", *turn]]).agg(F.min("s.oldest").alias("oldest"))
        return told.join(found.hint("merge"), ["state", "town", "group", "date", *turn]).select("_id", "oldest")

    place = ["state", "lga"]
    found = by_count(r.where("kl AND kidnapped BETWEEN 10 AND 99"), place, 3, 0.8, 1.2)
    # Rounding down and up widens 0.6 and 1.4 of counts from 100 on by less than a bucket; the narrower range is inside.
    found = found.unionByName(by_count(r.where("kl AND kidnapped >= 100"), place, 4, 0.6, 1.4))
    found = found.unionByName(by_count(r.where("kidnapped >= 50"), ["state"], 2, 0.8, 1.2)).unionByName(by_name()).unionByName(by_town())
    return found.groupBy(F.col("_id").alias("raw_id")).agg(F.min("oldest").alias("o")).select("raw_id", F.col("o._id").alias("match_id"), F.col("o.date").alias("match_date"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _inside(names: DataFrame, holders: DataFrame) -> DataFrame:
    """(name, holder): the different texts of one column that stand inside the different texts of the other: an equality with the pieces of the holders that are as long as some name."""
    asked, held = (x.toDF(c).distinct() for x, c in ((names, "name"), (holders, "holder")))
    # One row, as long as there are different lengths.
    sizes = asked.agg(F.collect_set(F.length("name")).alias("sizes"))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length("holder") - n + 1), lambda i: F.substring("holder", i, n))
    fits = F.filter("sizes", lambda n: n <= F.length("holder"))
    each = held.where("holder IS NOT NULL").crossJoin(F.broadcast(sizes)).select("holder", F.explode(F.array_distinct(F.flatten(F.transform(fits, pieces)))).alias("name"))
    return each.join(asked.hint("merge"), "name")


def cross_state_matches(raw: DataFrame, stored: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """(raw_id, match_id): of the ten first-created active rows of the same town in another state, of the day or a day next to it, the first that a shared source or like large counts confirm.

    added (match_id, u, since) are addresses that earlier reports of the batch have brought to stored rows.
    """
    day = F.col("date").cast("date")
    r = raw.where(_known("town")).withColumns({"k": F.lower(F.trim("town")), "d": F.explode(F.sequence(F.date_sub(day, 1), F.date_add(day, 1)))}).alias("r")
    s = stored.where(active() & F.col("state").isNotNull()).withColumns({"k": F.lower("town"), "d": day}).alias("s")
    # Ten rows of other states have at most ten of a report's own before them, if each state keeps its first ten: so the first twenty of a town and
    # day are all that any report of it can find. Versions of a row share its rank, and what a report does not see yet comes last.
    for keys, most in ((["k", "d", F.lower("state")], 10), (["k", "d"], 20)):
        s = s.withColumn("_nth", F.dense_rank().over(W.partitionBy(*keys).orderBy(*_age(stored)))).where(F.col("_nth") <= most).drop("_nth").alias("s")
    pairs = r.join(s, (F.col("r.k") == F.col("s.k")) & (F.col("r.d") == F.col("s.d")) & (F.lower("r.state") != F.lower("s.state")) & _seen(versioned="since" in stored.columns))
    order = W.partitionBy("r._id").orderBy(*_age(stored))
    urls = lambda c: F.filter(F.transform(F.coalesce(c, F.array()), lambda x: normalize_url(x["url"])), lambda u: u != "")
    shared = F.size(F.array_intersect(urls("r.sources"), urls("s.sources"))) >= 1
    large = (F.col("r.killed") >= 50) & _within(F.col("s.killed"), F.col("r.killed"), 0.8, 1.2) & F.col("r.kidnapped").eqNullSafe(F.col("s.kidnapped"))
    ten = pairs.select(F.col("r._id").alias("raw_id"), F.col("s._id").alias("match_id"), F.row_number().over(order).alias("rn"), (shared | F.coalesce(large, F.lit(False))).alias("ok")).where("rn <= 10")
    if added is not None:
        own = raw.select(F.col("_id").alias("raw_id"), "seq", F.explode(urls("sources")).alias("u"))
        late = ten.join(own, "raw_id").join(added, ["match_id", "u"]).where("since < seq").select("raw_id", "match_id").distinct().withColumn("late", F.lit(True))
        ten = ten.join(late, ["raw_id", "match_id"], "left").withColumn("ok", F.col("ok") | F.coalesce("late", F.lit(False)))
    return ten.where("ok").groupBy("raw_id").agg(F.min_by("match_id", "rn").alias("match_id"))


def with_hash(flat: DataFrame) -> DataFrame:
    return flat.withColumn("hash", attack_hash(F.col("date"), "state", "lga", "town", "group"))


def hash_matches(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """(raw_id, match_id) of every raw row: the stored row of its hash, the smallest _id if there are several, or null."""
    if "since" not in stored.columns:
        first = stored.groupBy("hash").agg(F.min("_id").alias("match_id"))
        return raw.select(F.col("_id").alias("raw_id"), "hash").join(first, "hash", "left").select("raw_id", "match_id")
    s = stored.groupBy("hash", "since", "until").agg(F.min("_id").alias("match_id")).alias("s")
    found = raw.alias("r").join(s, (F.col("r.hash") == F.col("s.hash")) & _seen(), "left")
    return found.groupBy(F.col("r._id").alias("raw_id")).agg(F.min("s.match_id").alias("match_id"))


def _decided(hashed: DataFrame, stored: DataFrame, added: DataFrame | None = None, some: bool = False) -> DataFrame:
    """(raw_id, action, target, step, target_date): what becomes of each report beside these stored rows: the first of hash, narrow, broad and cross-state matches (steps 0 to 3), an error (no town, and none of its hash), or an insertion.

    Each match is written before they are put together: as one plan their hundred stages would be planned anew after each of them. Where the reports
    are but `some`, stored rows are first reduced to those of the states and days, and of the towns and days, that they ask for.
    """
    placed = hashed.where("town IS NOT NULL")
    near = beside = stored
    if some:
        day = F.col("date").cast("date")
        asked = placed.select(F.lower("state").alias("_state"), F.explode(F.sequence(F.date_sub(day, 2), F.date_add(day, 2))).alias("_day")).distinct()
        near = stored.join(asked, (F.lower(stored["state"]) == F.col("_state")) & (stored["date"].cast("date") == F.col("_day")), "left_semi")
        asked = placed.select(F.lower(F.trim("town")).alias("_town"), F.explode(F.sequence(F.date_sub(day, 1), F.date_add(day, 1))).alias("_day")).distinct()
        beside = stored.join(asked, (F.lower(stored["town"]) == F.col("_town")) & (stored["date"].cast("date") == F.col("_day")), "left_semi")
    exact = lambda: hash_matches(hashed, stored).where("match_id IS NOT NULL")
    steps = [(exact, "merge"), (lambda: narrow_matches(placed, near), "merge"), (lambda: _followed_up(placed, stored), "merge_sources"), (lambda: cross_state_matches(placed, beside, added), "merge")]

    def written(i: int) -> DataFrame:
        m, action = steps[i][0](), steps[i][1]
        at = F.col("match_date") if "match_date" in m.columns else F.lit(None).cast("timestamp")
        return settled(m.select("raw_id", F.struct(F.lit(i).alias("step"), F.lit(action).alias("action"), F.col("match_id").alias("target"), at.alias("date")).alias("m")), "matches")

    # Side by side: none needs another's result, and each has stages with few tasks.
    with ThreadPoolExecutor(len(steps)) as pool:
        found = functools.reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(hashed.sparkSession)(written), range(len(steps))))
    best = found.groupBy("raw_id").agg(F.min("m").alias("m"))
    every = hashed.select(F.col("_id").alias("raw_id"), "town").join(best, "raw_id", "left")
    action = F.when(F.col("m").isNotNull(), F.col("m.action")).when(F.col("town").isNull(), "error").otherwise("insert")
    return every.select("raw_id", action.alias("action"), F.col("m.target").alias("target"), F.col("m.step").alias("step"), F.col("m.date").alias("target_date"))


def _touched(hashed: DataFrame, decided: DataFrame, changed: DataFrame) -> DataFrame:
    """The reports of hashed that may be decided otherwise, now that stored rows are seen in other versions: `changed` are these, as they were and as they are.

    Each match needs some equal keys, which are all that is compared: hash; state, day and one of town, LGA and group; state and one of LGA,
    town and a count, for reports that no hash or narrow match decides, and only by rows that are not younger than what they follow up; town and day,
    for those that nothing but the last match can decide.
    """
    low = lambda c: F.lower(F.col(c)).alias(c)
    day = F.col("date").cast("date")
    nlga = F.lower(F.when(text("lga") == "", "Unknown").otherwise(F.col("lga"))).alias("lga")
    r = hashed.select("_id", day.alias("day"), low("state"), low("town"), nlga, low("group"))
    r = r.select("_id", "state", "town", "lga", "group", F.explode(F.sequence(F.date_sub("day", 2), F.date_add("day", 2))).alias("d"))
    s = changed.select("_id", "hash", day.alias("d"), "date", low("state"), low("town"), low("lga"), low("group"), "kidnapped", "since")
    found = hashed.join(s.select("hash").distinct(), "hash", "left_semi").select("_id")
    for c in ("town", "lga", "group"):
        keys = ["state", "d", c]
        found = found.unionByName(r.join(s.select(*keys).distinct(), keys, "left_semi").select("_id"))
    open_ = hashed.where("town IS NOT NULL").join(decided.where("step IS NULL OR step >= 2").select(F.col("raw_id").alias("_id"), "step", "target_date"), "_id")
    bare = lambda c: F.lower(F.trim(F.col(c))).alias(c)
    o = open_.select("_id", low("state"), bare("lga"), bare("town"), "kidnapped", "target_date")
    for rows, held, keys in ((o, s, ["state", "lga"]), (o, s, ["state", "town"]), (o.where("kidnapped >= 50"), s.where("kidnapped > 0"), ["state"])):
        first = held.groupBy(*keys).agg(F.min("date").alias("_first"))
        found = found.unionByName(rows.join(first, keys).where("target_date IS NULL OR _first <= target_date").select("_id"))
    last = open_.where("step IS NULL OR step = 3").select("_id", "seq", low("state"), bare("town"), F.explode(F.sequence(F.date_sub(day, 1), F.date_add(day, 1))).alias("d")).alias("r")
    # Null, before the batch, is the least.
    there = s.groupBy("town", "d", "state").agg(F.min(F.struct("since")).alias("x")).alias("s")
    met = last.join(there, (F.col("r.town") == F.col("s.town")) & (F.col("r.d") == F.col("s.d")) & (F.col("r.state") != F.col("s.state")))
    found = found.unionByName(met.where("s.x.since IS NULL OR s.x.since < r.seq").select("r._id"))
    return hashed.join(found.distinct(), "_id", "left_semi")


def _standing_for(acts: DataFrame, named: DataFrame, names: list[str]) -> DataFrame:
    """acts with one insertion for each value of the columns names of named (raw_id, seq, ...): the report of smallest seq is inserted, the others merge into it."""
    new = acts.where("action = 'insert'").join(named.select("raw_id", "seq", *names), "raw_id").dropna(subset=names)
    first = new.groupBy(*names).agg(F.min(F.struct("seq", "raw_id")).alias("first"))
    others = new.join(first, names).where(F.col("raw_id") != F.col("first.raw_id")).select("raw_id", F.col("first.raw_id").alias("_first"))
    moved = acts.join(others, "raw_id", "left")
    return moved.select("raw_id", F.when(F.col("_first").isNotNull(), "merge").otherwise(F.col("action")).alias("action"), F.coalesce("_first", "target").alias("target"))


def _in_turn(raw: DataFrame) -> DataFrame:
    """raw with its hash and `seq`, which tells the order of reports; where there is none, _id does."""
    return with_hash(raw if "seq" in raw.columns else raw.withColumn("seq", F.col("_id")))


def plan(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """(raw_id, action, target): merge (all fields), merge_sources (later reports), insert, or error (no town), of reports that all find the stored rows as they were.

    Hash, narrow, broad and cross-state matches are tried in this order. Raw rows of one batch with one hash are one event: the
    first stands for it, the others merge into it. plan_in_order() also has what earlier reports of the batch have changed.
    """
    hashed = _in_turn(raw)
    return _standing_for(settled(_decided(hashed, stored), "decided"), hashed.withColumnRenamed("_id", "raw_id"), ["hash"])


#: What matches go by of stored rows.
MATCHED = ("_id", "hash", "date", "createdAt", "state", "lga", "town", "group", "title", "killed", "kidnapped", "sources", "_deleted")


def _as_it_was(hashed: DataFrame, stored: DataFrame, new: DataFrame, acts: DataFrame) -> DataFrame:
    """stored and the insertions of acts (of `new`, all reports as they would be inserted) as versions (since, until): a report of order seq sees those with since < seq <= until (null: from the start, to the end).

    A merge that brings a larger count ends a version and begins one; others leave the row as it is seen.
    """
    turn = hashed.schema["seq"].dataType
    done = hashed.select("_id", "seq", "killed", "kidnapped").join(acts.where("action = 'merge'").select(F.col("raw_id").alias("_id"), "target"), "_id")
    new = new.join(acts.where("action = 'insert'").select(F.col("raw_id").alias("_id")), "_id", "left_semi")
    base = stored.withColumns({c: F.lit(None).cast(turn) for c in ("since", "turn")}).unionByName(new)
    merged = done.where(" killed IS NOT NULL OR kidnapped IS NOT NULL").groupBy(F.col("target").alias("_of"), F.col("killed").alias("m_killed"), F.col("kidnapped").alias("m_kidnapped")).agg(F.min("seq").alias("m_seq"))
    has = base.select(F.col("_id").alias("_of"), F.col("killed").alias("b_killed"), F.col("kidnapped").alias("b_kidnapped"))
    more = any_of([F.col(f"m_{c}").isNotNull() & (F.col(f"b_{c}").isNull() | (F.col(f"m_{c}") > F.col(f"b_{c}"))) for c in ("killed", "kidnapped")])
    merged = merged.join(has, "_of").where(more)
    turns = W.partitionBy("_of").orderBy("m_seq", "m_killed", "m_kidnapped")
    steps = merged.select("_of", "m_seq", *[F.max(c).over(turns).alias(c) for c in ("m_killed", "m_kidnapped")])
    for c in ("m_killed", "m_kidnapped"):
        steps = steps.withColumn(f"{c}_before", F.lag(c).over(turns))
    steps = steps.where(~(F.col("m_killed").eqNullSafe(F.col("m_killed_before")) & F.col("m_kidnapped").eqNullSafe(F.col("m_kidnapped_before"))) | (F.col("m_killed_before").isNull() & F.col("m_kidnapped_before").isNull()))
    steps = steps.select("_of", "m_seq", "m_killed", "m_kidnapped", F.lead("m_seq").over(turns).alias("m_next"))
    first = merged.groupBy("_of").agg(F.min("m_seq").alias("until"))
    kept = base.join(first, base["_id"] == first["_of"], "left").drop("_of")
    later = base.join(steps, base["_id"] == steps["_of"]).withColumns({"since": F.col("m_seq"), "until": F.col("m_next"), **{c: merge_count(F.col(c), F.col(f"m_{c}")) for c in ("killed", "kidnapped")}})
    return kept.unionByName(later.select(kept.columns))


#: Insertions of a batch come after all that is stored, in the order of their turns.
LATEST = dt.datetime(9999, 1, 1)


def plan_in_order(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """(raw_id, action, target) as plan(), of reports that come one after the other: each finds what the earlier ones have inserted and changed.

    By rounds: the decisions of a round say in which versions the rows are seen at each turn, and the reports are decided anew beside
    these, until no decision changes. The first rounds decide all reports, later ones those that a row can reach which is seen otherwise than
    in the round before; the others' decisions stand. Each round settles the first report that is not yet settled, and all that do not
    depend on others; so the last round's are those of one pass in order, and there are as many rounds as the longest chain of
    reports that depend on each other. Reports that would all be inserted, though an earlier one of the same hash, or day and place,
    is inserted, are taken to merge into the first of them until a round says into which row.
    """
    hashed, day = settled(_in_turn(raw), "reports"), F.col("date").cast("date")
    # Only of fields that an insertion leaves as they are: else the later report would not find it by them.
    same = lambda c, kept=None: F.when(F.lower(sanitize(c) if kept is None else kept) == F.lower(c), F.lower(c))
    state = same("state", normalize_state(sanitize("state")))
    named = settled(hashed.select(F.col("_id").alias("raw_id"), "seq", "hash", day.alias("day"), state.alias("state"), *[same(c).alias(c) for c in ("town", "lga", "group")]), "names")
    keys = [["hash"], ["state", "town", "day"], ["state", "lga", "group", "day"]]
    stored = stored.select(*[c for c in MATCHED if c in stored.columns])
    as_new = inserted(hashed, stored.columns, F.lit(LATEST)).join(hashed.select("_id", F.col("seq").alias("since"), F.col("seq").alias("turn")), "_id")
    as_new = settled(as_new, "as-inserted")

    def one_of_each(acts: DataFrame) -> DataFrame:
        # Written at each step, for the next reads it more than once.
        for k in keys:
            acts = settled(_standing_for(acts, named, k), "decisions")
        return acts

    decided = settled(_decided(hashed, stored), "decided")
    acts = one_of_each(decided)
    urls = F.explode(F.filter(F.transform("sources", lambda x: normalize_url(x["url"])), lambda u: u != ""))
    before = changed = None
    while True:
        seen = settled(_as_it_was(hashed, stored, as_new, acts), "versions")
        done = hashed.join(acts.select(F.col("raw_id").alias("_id"), "action", "target"), "_id").where("action IN ('merge', 'merge_sources')")
        added = settled(done.select(F.col("target").alias("match_id"), urls.alias("u"), "seq").groupBy("match_id", "u").agg(F.min("seq").alias("since")), "added-sources")
        if before is None:
            decided = settled(_decided(hashed, seen, added), "decided")
        else:
            other = settled(before.unionByName(seen).join(changed, "_id", "left_semi"), "changed-rows")
            some = settled(_touched(hashed, decided, other), "touched")
            fresh = settled(_decided(some, seen, added, some=True), "decided-anew")
            decided = settled(decided.join(some.select(F.col("_id").alias("raw_id")), "raw_id", "left_anti").unionByName(fresh), "decided")
        new = one_of_each(decided)
        # Null-safe, for insertions have no target.
        kept = F.col("a.action").eqNullSafe(F.col("b.action")) & F.col("a.target").eqNullSafe(F.col("b.target"))
        differ = acts.alias("a").join(new.alias("b"), F.col("a.raw_id") == F.col("b.raw_id")).where(~kept)
        # The rows that reports were or are merged into, and those that are inserted now or were.
        own = F.when((F.col("a.action") == "insert") | (F.col("b.action") == "insert"), F.col("a.raw_id"))
        changed = settled(differ.select(F.explode(F.array("a.target", "b.target", own)).alias("_id")).where("_id IS NOT NULL").distinct(), "changed")
        if changed.isEmpty():
            return new
        acts, before = new, seen


def inserted(raw: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """New incidents of raw reports: texts sanitised, unknown places named, the canonical state, and `now` as both times."""
    plain = {c: sanitize(c) for c in ("title", "description", "group")} | {c: sanitize(F.when(text(c) == "", "Unknown").otherwise(F.col(c))) for c in ("lga", "town")}
    plain |= {"state": normalize_state(sanitize("state")), "status": F.coalesce("status", F.lit("unconfirmed")), "_deleted": F.lit(False), "createdAt": now, "updatedAt": now}
    clean = lambda s: F.struct(*[sanitize(text(s[c])).alias(c) for c in ("url", "title", "publisher")])
    plain["sources"] = F.transform("sources", clean)
    if "tags" in columns:
        plain["tags"] = F.transform(F.coalesce("tags", F.array()), lambda t: sanitize(t))
    out = raw.withColumns({c: v for c, v in plain.items() if c in columns or c in raw.columns})
    return out.select(*[c if c in out.columns else F.lit(None).alias(c) for c in columns])


def apply(raw: DataFrame, stored: DataFrame, now: Column, actions: DataFrame | None = None) -> DataFrame:
    """stored (flat, with hash) after raw reports have been taken in by plan_in_order(): merged, their sources added, or inserted under their own _id.

    Run again with the same reports it changes nothing but what a second report of the same event would: inserted ones are then
    found by their hash, and hashes stay unique. Reports without usable sources are left out, as are those in error.
    """
    return upsert(stored, changes(raw, stored, now, actions))


def changes(raw: DataFrame, stored: DataFrame, now: Column, actions: DataFrame | None = None) -> DataFrame:
    """The rows that apply() adds to stored or changes there."""
    # Each step below reads the plan.
    ready = settled(_in_turn(usable(raw)), "usable-reports")
    acts = settled(plan_in_order(ready, stored) if actions is None else actions, "ingest-plan")
    done = ready.join(acts.select(F.col("raw_id").alias("_id"), "action", "target"), "_id")
    new = settled(inserted(done.where("action = 'insert'").drop("action", "target"), stored.columns, now), "insertions")
    return upsert(new, settled(merged_reports(stored.unionByName(new), done.where("action IN ('merge', 'merge_sources')"), now), "merges"))


def merged_reports(base: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The rows of base that reports (with seq, action, target) are merged into, after them, in the order of seq: larger counts, a confirmed status and each address once for merges, new sources of all.

    Sources are told apart by their address before they are gathered, so a row's list is no longer than what it comes to hold. A row
    whose reports bring nothing is as it was, its updatedAt too.
    """
    whole = done.where("action = 'merge'").groupBy(F.col("target").alias("_id")).agg(*[F.max(c).alias(f"m_{c}") for c in CASUALTIES], F.max(F.coalesce(F.col("status") == "confirmed", F.lit(False))).alias("m_confirmed"))
    clean = F.struct(*[sanitize(text(F.col("s")[c])).alias(c) for c in ("url", "title", "publisher")])
    each = done.select(F.col("target").alias("_id"), "seq", F.posexplode("sources").alias("pos", "s")).withColumns({"s": clean, "k": normalize_url("s.url")}).where("k <> ''")
    first = each.groupBy("_id", "k").agg(F.min(F.struct("seq", "pos", "s")).alias("x"))
    more = first.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("x.seq", "x.pos", "x.s"))), lambda x: x["s"]).alias("m_sources"))
    touched = base.join(whole.join(more, "_id", "full"), "_id")
    new = {c: merge_count(F.col(c), F.col(f"m_{c}")) for c in CASUALTIES if c in base.columns} | {"status": F.when(F.col("m_confirmed"), "confirmed").otherwise(F.col("status")), "sources": F.when(F.col("m_confirmed").isNotNull(), merge_sources(F.col("sources"), F.col("m_sources"))).otherwise(F.concat(F.coalesce("sources", F.array()), new_sources(F.col("sources"), F.col("m_sources"))))}
    differs = any_of([~F.col(c).eqNullSafe(v) for c, v in new.items()])
    changed = touched.withColumn("_differs", differs).where("_differs").withColumns(new)
    return (changed.withColumn("updatedAt", now) if "updatedAt" in base.columns else changed).select(base.columns)


def counters(actions: DataFrame) -> DataFrame:
    """(saved, merged, errors) of a plan."""
    return actions.agg(F.count_if(F.col("action") == "insert").alias("saved"), F.count_if(F.col("action").isin("merge", "merge_sources")).alias("merged"), F.count_if(F.col("action") == "error").alias("errors"))


def usable(raw: DataFrame, trusted_only: bool = False) -> DataFrame:
    """raw with the sources that have a usable address (and are trusted), and without rows that have none left."""
    def good(s: Column) -> Column:
        return is_usable_url(s["url"]) & (is_trusted_source(s["url"], s["publisher"]) if trusted_only else F.lit(True))

    return raw.withColumn("sources", F.filter(F.coalesce("sources", F.array()), good)).where(F.size("sources") > 0)


#: Sources kept of a report, and how old they may be at the end of its window.
MOST_SOURCES, SOURCE_AGE_DAYS = 3, 21


def complete(raw: DataFrame) -> Column:
    """Whether the required fields are there; an empty text is none."""
    rules = [text(c) != "" for c in ("title", "description", "state", "group")] + [F.col("date").isNotNull()]
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return out


def near_window(first: Column, last: Column, days: int = 1) -> Column:
    """Whether the date is in a window that is wider by `days` on both sides."""
    return (F.col("date") >= first - F.make_interval(days=F.lit(days))) & (F.col("date") <= last + F.make_interval(days=F.lit(days)))


def of_states(raw: DataFrame, states: list[str]) -> DataFrame:
    """Rows of the states listed, whatever the case of letters; the list is a fixed small one."""
    return raw.where(F.lower(normalize_state("state")).isin([x.lower() for x in states]))


def with_civilians(raw: DataFrame) -> DataFrame:
    """Without rows that say that no civilian was harmed; those that say nothing stay."""
    return raw.where(~F.col("civilianCasualties").eqNullSafe(F.lit(False)))


def fresh(published: Column, last: Column, days: int = SOURCE_AGE_DAYS) -> Column:
    """Whether a source is not older than `days` at the end of a window; an unknown time passes."""
    return published.isNull() | (published >= last - F.make_interval(days=F.lit(days)))


def recent(flat: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Rows of the last hours before as_of, by date."""
    return flat.where((F.col("date") >= as_of - F.make_interval(hours=F.lit(hours))) & (F.col("date") < as_of))


REDIRECT = "grounding-api-redirect"


def resolved(raw: DataFrame, redirects: DataFrame) -> DataFrame:
    """raw with the addresses of its sources that are redirects replaced by where they lead, by redirects (url, final_url); those that lead nowhere of use go."""
    each = raw.select("_id", F.posexplode("sources").alias("pos", "s")).withColumn("_url", F.col("s.url"))
    known = redirects.select(F.col("url").alias("_from"), F.col("final_url").alias("_to")).dropDuplicates(["_from"])
    led = each.join(known, F.col("_url") == F.col("_from"), "left").withColumn("_is", F.contains(text("_url"), F.lit(REDIRECT)))
    kept = led.where(~F.col("_is") | (F.col("_to").isNotNull() & is_usable_url("_to")))
    new = kept.withColumn("s", F.when(F.col("_is"), F.struct(F.col("_to").alias("url"), F.col("s.title").alias("title"), F.col("s.publisher").alias("publisher"))).otherwise(F.col("s")))
    lists = new.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("_sources"))
    return raw.join(lists, "_id", "left").withColumn("sources", F.coalesce("_sources", F.array().cast(raw.schema["sources"].dataType))).drop("_sources")


def inspected(raw: DataFrame, pages: DataFrame, last: Column, most: int = MOST_SOURCES, days: int = SOURCE_AGE_DAYS) -> DataFrame:
    """raw with the first `most` sources of each report that hold up; reports without any go.

    pages (url, final_url, html) are what fetching gave; a source without a page is trusted as it is. A page gives the source its
    final address and title, must be relevant to the event, and must not be older than `days` at the window's end. Each distinct
    page is read once.
    """
    seen = pages.select(F.col("url").alias("_page"), F.coalesce("final_url", "url").alias("_final"), html_title("html").alias("_title"), published_date("html", F.coalesce("final_url", "url")).alias("_published")).dropDuplicates(["_page"])
    places = location_tokens("state", "lga", "town")
    told = raw.select("_id", places.alias("_places"), "title", "group", "description", F.posexplode("sources").alias("pos", "s")).withColumn("_meaning", semantic_tokens("title", "group", "description", F.col("_places")))
    each = told.join(seen, F.col("s.url") == F.col("_page"), "left").where(is_usable_url("s.url"))
    address = F.when(is_usable_url("_final"), F.col("_final")).otherwise(F.col("s.url"))
    title = F.coalesce(F.nullif("_title", F.lit("")), F.nullif("s.title", F.lit("")), F.lit(""))
    good = F.col("_page").isNull() | source_relevant(F.col("_places"), F.col("_meaning"), title, address)
    kept = each.where(good & fresh(F.col("_published"), last, days)).select("_id", "pos", F.struct(F.when(F.col("_page").isNull(), F.col("s.url")).otherwise(address).alias("url"), title.alias("title"), F.col("s.publisher").alias("publisher")).alias("s"))
    lists = kept.groupBy("_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "s"))), 1, most), lambda x: x["s"]).alias("_sources"))
    return raw.join(lists, "_id").withColumn("sources", F.col("_sources")).drop("_sources")


def normalized(raw: DataFrame, first: Column, last: Column, redirects: DataFrame | None = None, pages: DataFrame | None = None, most_sources: int = MOST_SOURCES, days: int = SOURCE_AGE_DAYS) -> DataFrame:
    """Raw reports made ready: trusted sources, canonical state, required fields, no operational updates, the date that the narrative tells, inside the window, distinct sources, redirects followed, pages inspected, `most_sources` of them at most."""
    out = raw.repartition("_id").withColumn("sources", F.filter(F.coalesce("sources", F.array()), lambda s: is_trusted_source(s["url"], s["publisher"]))).where(F.size("sources") > 0)
    out = out.withColumn("state", normalize_state("state")).where(complete(out)).where(~is_operational_update())
    out = out.withColumn("date", bound(F.coalesce(narrative_date("description"), F.col("date")), lambda told: reconcile(F.col("date"), told))).where(F.col("date").between(first, last))
    same = lambda s: F.lower(F.concat_ws("|", text(s["url"]), text(s["title"]), text(s["publisher"])))
    keys = lambda xs: F.transform(xs, same)
    out = out.withColumn("_keys", keys(F.col("sources"))).withColumn("sources", F.filter("sources", lambda s, i: F.array_position(F.col("_keys"), same(s)) == i + 1)).drop("_keys")
    out = out if redirects is None else resolved(out, redirects)
    if pages is not None:
        return inspected(out, pages, last, most_sources, days)
    return usable(out).withColumn("sources", F.slice("sources", 1, most_sources))


def best_chunk(sources: DataFrame, chunks: DataFrame, score: Column) -> DataFrame:
    """(raw_id, pos, uri): of the chunks of a report, the one of best `score` (2 at least) for each source, the earlier on ties."""
    pairs = sources.alias("s").join(chunks.alias("c"), "raw_id").withColumn("score", score).where("score >= 2")
    order = W.partitionBy("raw_id", "s.pos").orderBy(F.desc("score"), "c.pos")
    return pairs.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("raw_id", F.col("s.pos").alias("pos"), F.col("c.uri").alias("uri"))


def _wanting(url: Column) -> Column:
    """Sources that need an address: a redirect, or none."""
    return F.contains(text(url), F.lit(REDIRECT)) | ~F.startswith(text(url), F.lit("http"))


def chunk_addresses(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """raw with the addresses of sources that are redirects or none taken from the report's own chunks (raw_id, pos, uri, title), by the first of four tiers that has one.

    In order: the chunk of best score, from 2 on; one of the publisher's own domain; a trusted one that is relevant to the event;
    any trusted one. Inside a tier the better score, then the earlier chunk; without one the address stays.
    """
    each = raw.select(F.col("_id").alias("raw_id"), "state", "lga", "town", "title", "group", "description", F.posexplode("sources").alias("pos", "s"))
    told = each.withColumn("_places", location_tokens("state", "lga", "town")).withColumn("_meaning", semantic_tokens("title", "group", "description", F.col("_places")))
    c = chunks.where("uri IS NOT NULL AND uri <> '' AND title IS NOT NULL AND title <> ''").select("raw_id", F.col("pos").alias("c_pos"), "uri", F.col("title").alias("c_title"))
    # Dealt out before words are compared: however few files the reports lie in, all tasks take part.
    pairs = told.where(_wanting(F.col("s.url"))).join(c, "raw_id").repartition("raw_id")
    pairs = pairs.withColumn("_domain", extract_domain("uri")).withColumn("_relevant", source_relevant(F.col("_places"), F.col("_meaning"), "c_title", "uri"))
    domain, relevant = F.col("_domain"), F.col("_relevant")
    trusted = domain.isin(V.TRUSTED_DOMAINS) | root_domain(domain).isin(V.TRUSTED_DOMAINS)
    publisher = F.lower(text("s.publisher"))
    own = F.lit(None).cast("string")
    for name, host in reversed(V.PUBLISHER_TIERS):
        own = F.when(F.contains(publisher, F.lit(name)), F.lit(host)).otherwise(own)
    of_publisher = F.coalesce((domain == own) | F.endswith(domain, F.concat(F.lit("."), own)), F.lit(False))
    scored = pairs.withColumn("score", chunk_score("s.title", "s.publisher", "c_title", "uri", relevant))
    tier = F.when(F.col("score") >= 2, 1).when(of_publisher, 2).when(trusted & relevant, 3).when(trusted, 4)
    # Out of a list, so that the condition is not worked out on top of the value.
    ranked = scored.select("raw_id", "pos", "c_pos", "uri", "score", F.explode(F.filter(F.array(tier), lambda t: t.isNotNull())).alias("tier"))
    return _with_addresses(raw, ranked, ["tier", F.desc("score"), "c_pos"], None)


def gap_chunk_addresses(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """The simpler rule of gap scans: twice the shared words of titles and the words of the event, 2 at least; else the address becomes empty."""
    each = raw.select(F.col("_id").alias("raw_id"), "state", "town", "title", "group", F.posexplode("sources").alias("pos", "s"))
    c = chunks.where("uri IS NOT NULL AND uri <> '' AND title IS NOT NULL AND title <> ''").select("raw_id", F.col("pos").alias("c_pos"), "uri", F.col("title").alias("c_title"))
    event = F.array_distinct(F.concat(tokenize("title"), tokenize("state", 3), tokenize("town", 3), tokenize("group")))
    theirs = tokenize("c_title", 3)
    score = bound(theirs, lambda words: 2 * shared_words(words, tokenize("s.title", 3)) + shared_words(words, event))
    pairs = each.where(_wanting(F.col("s.url"))).join(c.hint("merge"), "raw_id").repartition("raw_id")
    scored = pairs.select("raw_id", "pos", "c_pos", "uri", F.explode(F.filter(F.array(score), lambda n: n >= 2)).alias("score"))
    return _with_addresses(raw, scored, [F.desc("score"), "c_pos"], "")


def title_chunk_addresses(raw: DataFrame, chunks: DataFrame, search: str = "https://www.google.com/search?q=") -> DataFrame:
    """The rule of backfills: the first chunk whose title holds the source's or is held by it; else the address of a search for the event's title."""
    each = raw.select(F.col("_id").alias("raw_id"), F.posexplode("sources").alias("pos", "s"))
    c = chunks.where("uri IS NOT NULL AND uri <> '' AND title IS NOT NULL AND title <> ''").select("raw_id", F.col("pos").alias("c_pos"), "uri", F.lower("title").alias("c_title"))
    mine = F.lower(text("s.title"))
    found = each.where(_wanting(F.col("s.url"))).join(c, "raw_id").where((mine != "") & (F.contains("c_title", mine) | F.contains(mine, F.col("c_title"))))
    return _with_addresses(raw, found, ["c_pos"], search)


def _with_addresses(raw: DataFrame, found: DataFrame, order: list[str | Column], missing: str | None) -> DataFrame:
    """raw with the first uri of `found` (raw_id, pos, uri) in `order` as the address of each source that wants one; without one: `missing`, with the event's title if that is a search, or the address as it is (null)."""
    best = found.withColumn("rn", F.row_number().over(W.partitionBy("raw_id", "pos").orderBy(*order))).where("rn = 1").groupBy("raw_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "uri"))).alias("_uris"))
    # Reports and their addresses grow alike; small files as they are, the driver would hold them by far larger to broadcast them.
    joined = raw.join(best.hint("merge"), raw["_id"] == best["raw_id"], "left").drop("raw_id")

    def address(s: Column, i: Column) -> Column:
        other = s["url"] if missing is None else F.lit("") if not missing else F.concat(F.lit(missing), F.replace(F.url_encode(text("title")), F.lit("+"), F.lit("%20")))
        return F.when(_wanting(s["url"]), F.coalesce(F.try_element_at("_uris", i), other)).otherwise(s["url"])

    new = F.transform("sources", lambda s, i: F.struct(address(s, i).alias("url"), s["title"].alias("title"), s["publisher"].alias("publisher")))
    return joined.withColumn("sources", new).drop("_uris")
