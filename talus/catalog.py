"""All registered queries with their oracle SQL."""

from __future__ import annotations

import datetime as dt
import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, text, urls
from .functions import values as V
from .operators import classify, dedup, filters, ingest, judge, merge, repair, score, stats
from .operators.filters import IncidentQuery
from .plans import views
from .plans.views import AS_OF, DOC, INC, REP, SRC
from .sources import files
from .sources.store import Store
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Integers as long and times as text, so that results compare alike in any engine."""
    kinds = {"int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "date": lambda c: F.date_format(c, "yyyy-MM-dd")}
    return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(spark, sf_dir))

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return register


DAY = "strftime({}, '%Y-%m-%d %H:%M:%S')"
LISTED = ("_id", "state", "group", "status", "killed")
SQL_LISTED = 'SELECT _id, state, "group", status, killed FROM act'


def listed(name: str, q: IncidentQuery, where: str, sources: bool = False, more: str = "") -> None:
    """A filter query: the columns of LISTED of the rows that q leaves."""

    @query(name, f"WITH {INC}{', ' + SRC if sources else ''} {SQL_LISTED} {where} {more}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.where(views.incidents(spark, sf_dir, sources), q).select(*LISTED)


listed("filter_active", IncidentQuery(), "")
listed("filter_state", IncidentQuery(state="nation_3 State"), "WHERE lower(state) = 'nation_3'")
listed("filter_group", IncidentQuery(group="HIGH"), "WHERE contains(lower(\"group\"), 'high')")
listed("filter_status", IncidentQuery(status="developing"), "WHERE status = 'developing'")
listed("filter_source", IncidentQuery(source="Supplier#000000003"), "WHERE _id IN (SELECT _id FROM src WHERE publisher = 'Supplier#000000003')", sources=True)
listed("filter_month", IncidentQuery(month="1998-02", start=dt.datetime(2000, 1, 1)), "WHERE date >= '1998-02-01' AND date < '1998-03-01'")
listed("filter_date_range", IncidentQuery(start=dt.datetime(1997, 1, 1), end=dt.datetime(1997, 6, 30)), "WHERE date >= '1997-01-01' AND date <= '1997-06-30'")
listed("filter_search", IncidentQuery(search="Hostages"), "WHERE contains(lower(title), 'hostages') OR contains(lower(description), 'hostages') OR contains(lower(town), 'hostages') OR contains(lower(\"group\"), 'hostages')")
listed("filter_casualty_type", IncidentQuery(casualty_type="kidnapped"), "WHERE kidnapped > 0")
listed("filter_combined", IncidentQuery(group="urgent", status="confirmed", casualty_type="killed", month="1996-05"), "WHERE contains(lower(\"group\"), 'urgent') AND status = 'confirmed' AND killed > 0 AND date >= '1996-05-01' AND date < '1996-06-01'")


@query("filter_fct", f"WITH {REP} SELECT event_id FROM rep WHERE lower(state_raw) IN ('federal capital territory', 'fct', 'abuja')")
def filter_fct(spark, sf_dir):
    return views.reports(spark, sf_dir).where(filters.state_is("Abuja", "state_raw")).select("event_id")


@query("validate_input", f"""WITH {INC}, {SRC}, b AS (SELECT _id, count(*) FILTER (WHERE NOT regexp_matches(url, '^[a-z]+://') OR length(url) > 2000) AS bad, count(*) AS n FROM (SELECT _id, CASE WHEN _id % 16 = 10 AND pos = min(pos) OVER (PARTITION BY _id) THEN 'nope' ELSE url END AS url FROM src) GROUP BY 1),
m AS (SELECT *, _id % 16 AS k FROM inc LEFT JOIN b USING (_id)),
v AS (SELECT _id, k, CASE k WHEN 0 THEN ' abcd ' ELSE title END AS title, CASE k WHEN 1 THEN 'too short' ELSE description END AS description, CASE k WHEN 2 THEN ' ' ELSE state END AS state, CASE k WHEN 3 THEN repeat('g', 201) ELSE "group" END AS "group",
CASE k WHEN 4 THEN -1 ELSE killed END AS killed, injured, kidnapped, displaced, CASE k WHEN 5 THEN 'odd' WHEN 15 THEN NULL ELSE status END AS status, CASE k WHEN 6 THEN 21 ELSE 1 END AS n_tags, CASE k WHEN 7 THEN 51 ELSE 3 END AS tag_length, CASE k WHEN 8 THEN 91.0 ELSE 9.0 END AS lat,
CASE k WHEN 9 THEN repeat('t', 101) ELSE town END AS town, lga, coalesce(bad, 0) AS bad, coalesce(n, 0) AS n, CASE k WHEN 11 THEN NULL ELSE date END AS date FROM m)
SELECT _id, length(trim(title)) >= 5 AND length(trim(title)) <= 500 AND length(trim(description)) >= 10 AND length(trim(description)) <= 5000 AND length(trim(state)) >= 1 AND length(trim(state)) <= 100 AND length(trim("group")) >= 1 AND length(trim("group")) <= 200
AND length(trim(town)) <= 100 AND length(trim(lga)) <= 100 AND date IS NOT NULL AND coalesce(killed, 0) >= 0 AND coalesce(injured, 0) >= 0 AND coalesce(kidnapped, 0) >= 0 AND coalesce(displaced, 0) >= 0 AND coalesce(status, 'unconfirmed') IN ('confirmed', 'unconfirmed', 'developing')
AND n_tags <= 20 AND tag_length <= 50 AND lat BETWEEN -90 AND 90 AND bad = 0 AND n <= 20 AS ok FROM v""")
def validate_input(spark, sf_dir):
    """Incidents of which one in sixteen breaks each rule."""
    from .schema import valid

    k, flat = F.col("_id") % 16, views.incidents(spark, sf_dir, sources=True)
    odd = lambda i, value, c: F.when(k == i, F.lit(value)).otherwise(F.col(c))
    rows = flat.withColumns({
        "title": odd(0, " abcd ", "title"), "description": odd(1, "too short", "description"), "state": odd(2, " ", "state"), "group": odd(3, "g" * 201, "group"), "killed": odd(4, -1, "killed"),
        "status": F.when(k == 5, "odd").when(k != 15, F.col("status")), "tags": F.when(k == 6, F.array_repeat(F.lit("tag"), 21)).when(k == 7, F.array(F.lit("t" * 51))).otherwise(F.array(F.lit("tag"))),
        "coordinates": F.struct(F.when(k == 8, 91.0).otherwise(9.0).alias("lat"), F.lit(8.0).alias("lng")), "town": odd(9, "t" * 101, "town"),
        "sources": F.transform("sources", lambda s, i: F.when((k == 10) & (i == 0), s.withField("url", F.lit("nope"))).otherwise(s)), "date": F.when(k != 11, F.col("date")),
    })
    return rows.select("_id", valid(rows).alias("ok"))


def paged(name: str, q: IncidentQuery, order: str) -> None:
    @query(name, f"WITH {INC} {SQL_LISTED} WHERE coalesce(killed, 0) >= 0 ORDER BY {order} LIMIT {q.limit} OFFSET {(q.page - 1) * q.limit}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.page(views.incidents(spark, sf_dir), q).select(*LISTED)


paged("sort_date", IncidentQuery(limit=50), "date DESC, _id")
paged("sort_date_asc", IncidentQuery(limit=50, sort="date-asc"), "date, _id")
paged("sort_casualties", IncidentQuery(limit=50, sort="casualties-desc"), "coalesce(killed, 0) + coalesce(injured, 0) + coalesce(kidnapped, 0) DESC, date DESC, _id")
paged("paginate", IncidentQuery(page=7, limit=12), "date DESC, _id")


@query("pagination_meta", f"WITH {INC} SELECT count(*) AS total, ceil(count(*) / 12.0)::bigint AS pages, 7 < ceil(count(*) / 12.0) AS has_next, true AS has_prev FROM act WHERE status = 'confirmed'")
def pagination_meta(spark, sf_dir):
    total = F.count("*")
    pages = F.ceil(total / 12)
    return filters.where(views.incidents(spark, sf_dir), IncidentQuery(status="confirmed")).agg(total.alias("total"), pages.cast("long").alias("pages"), (F.lit(7) < pages).alias("has_next"), F.lit(True).alias("has_prev"))


@query("agg_totals", f"WITH {INC} SELECT count(*) AS total, coalesce(sum(killed), 0)::bigint AS killed, coalesce(sum(injured), 0)::bigint AS injured, coalesce(sum(kidnapped), 0)::bigint AS kidnapped FROM act")
def agg_totals(spark, sf_dir):
    return filters.totals(filters.where(views.incidents(spark, sf_dir), IncidentQuery()))


@query("agg_count_filtered", f"WITH {INC} SELECT count(*) AS total FROM act WHERE status = 'unconfirmed'")
def agg_count_filtered(spark, sf_dir):
    return filters.where(views.incidents(spark, sf_dir), IncidentQuery(status="unconfirmed")).agg(F.count("*").alias("total"))


YEAR = f"date >= '{AS_OF.year}-01-01'"


@query("stats_overview", f"""WITH {INC} SELECT count(*) FILTER (WHERE {YEAR}) AS total_incidents, coalesce(sum(killed) FILTER (WHERE {YEAR}), 0)::bigint AS total_killed,
coalesce(sum(injured) FILTER (WHERE {YEAR}), 0)::bigint AS total_injured, coalesce(sum(kidnapped) FILTER (WHERE {YEAR}), 0)::bigint AS total_kidnapped,
count(*) FILTER (WHERE date >= '{AS_OF - dt.timedelta(days=30)}') AS last_30_days, count(*) FILTER (WHERE date >= '{AS_OF - dt.timedelta(days=7)}') AS last_7_days FROM act""")
def stats_overview(spark, sf_dir):
    return stats.overview(views.incidents(spark, sf_dir), AS_OF)


@query("stats_by_state", f"WITH {INC} SELECT state, count(*) AS cnt FROM act WHERE {YEAR} GROUP BY state ORDER BY cnt DESC, state LIMIT 10")
def stats_by_state(spark, sf_dir):
    return stats.by_state(views.incidents(spark, sf_dir), AS_OF)


@query("stats_by_group", f'WITH {INC} SELECT "group", count(*) AS cnt, coalesce(sum(killed), 0)::bigint AS killed FROM act WHERE {YEAR} GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 10')
def stats_by_group(spark, sf_dir):
    return stats.by_group(views.incidents(spark, sf_dir), AS_OF)


@query("stats_by_month", f"""WITH {INC}, m AS (SELECT month(date) AS month, count(*) AS n, sum(killed) AS k, sum(kidnapped) AS p FROM act WHERE {YEAR} GROUP BY 1)
SELECT r.range AS month, coalesce(n, 0) AS incidents, coalesce(k, 0)::bigint AS killed, coalesce(p, 0)::bigint AS kidnapped FROM range(1, {AS_OF.month + 1}) r LEFT JOIN m ON m.month = r.range""")
def stats_by_month(spark, sf_dir):
    return stats.by_month(views.incidents(spark, sf_dir), AS_OF)


@query("calendar_fill", """WITH m AS (SELECT month(ts) AS month, count(*) AS n FROM events GROUP BY 1) SELECT r.range AS month, coalesce(n, 0) AS n FROM range(1, 13) r LEFT JOIN m ON m.month = r.range""")
def calendar_fill(spark, sf_dir):
    n = views.load(spark, sf_dir, "events").groupBy(F.month("ts").cast("long").alias("month")).agg(F.count("*").alias("n"))
    return spark.range(1, 13).withColumnRenamed("id", "month").join(n, "month", "left").na.fill(0)


@query("agg_year_month", f"WITH {INC} SELECT strftime(date, '%Y-%m') AS ym, count(*) AS incidents, coalesce(sum(killed), 0)::bigint AS killed, coalesce(sum(kidnapped), 0)::bigint AS kidnapped FROM act GROUP BY 1")
def agg_year_month(spark, sf_dir):
    return stats.by_year_month(views.incidents(spark, sf_dir))


@query("agg_month_samples", f"""WITH {INC}, n AS (SELECT *, strftime(date, '%Y-%m') AS ym, row_number() OVER (PARTITION BY strftime(date, '%Y-%m') ORDER BY date, _id) AS rn FROM act)
SELECT ym, count(*) AS incidents, coalesce(sum(killed), 0)::bigint AS killed, string_agg(_id::varchar, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS samples FROM n GROUP BY ym""")
def agg_month_samples(spark, sf_dir):
    return stats.month_samples(views.incidents(spark, sf_dir))


@query("distinct_publishers", f"WITH {INC}, {SRC} SELECT DISTINCT publisher FROM src JOIN act USING (_id) WHERE publisher <> ''")
def distinct_publishers(spark, sf_dir):
    return stats.publishers(views.incidents(spark, sf_dir, sources=True))


MAP = f"""newest AS (SELECT * FROM act ORDER BY date DESC, _id LIMIT 1000), per AS (SELECT lower(state) AS key, count(*) AS cnt, sum(coalesce(killed, 0))::bigint AS killed,
sum(coalesce(injured, 0))::bigint AS injured, sum(coalesce(kidnapped, 0))::bigint AS kidnapped FROM newest GROUP BY 1),
filled AS (SELECT n_name AS state, coalesce(cnt, 0) AS cnt, coalesce(killed, 0) AS killed, coalesce(injured, 0) AS injured, coalesce(kidnapped, 0) AS kidnapped FROM nation LEFT JOIN per ON lower(n_name) = key),
lit AS (SELECT *, cnt::double / greatest(1, max(cnt) OVER ()) AS i FROM filled)"""


@query("map_by_state", f"""WITH {INC}, {MAP} SELECT state, cnt, killed, injured, kidnapped, i AS intensity, CASE WHEN i = 0 THEN 'muted' WHEN i > 0.7 THEN 'urgent' WHEN i > 0.4 THEN 'ember' WHEN i > 0.15 THEN 'caution' ELSE 'safe' END AS bucket,
CASE WHEN i = 0 THEN 4.0::double ELSE 6 + 14 * i END AS radius, CASE WHEN i = 0 THEN 0.2::double ELSE 0.3::double + 0.5::double * i END AS opacity FROM lit""")
def map_by_state(spark, sf_dir):
    return stats.map_by_state(views.incidents(spark, sf_dir), views.load(spark, sf_dir, "nation").select(F.col("n_name").alias("state")))


@query("max_state_count", f"WITH {INC} SELECT greatest(1, max(cnt)) AS top FROM (SELECT count(*) AS cnt FROM act GROUP BY state)")
def max_state_count(spark, sf_dir):
    return views.incidents(spark, sf_dir).where(filters.active()).groupBy("state").agg(F.count("*").alias("cnt")).agg(F.greatest(F.lit(1), F.max("cnt")).alias("top"))


@query("rank_states", f"WITH {INC} SELECT state, cnt, row_number() OVER (ORDER BY cnt DESC, state) AS rank, cnt * 100.0::double / max(cnt) OVER () AS share FROM (SELECT state, count(*) AS cnt FROM act GROUP BY state)")
def rank_states(spark, sf_dir):
    return stats.ranked_states(views.incidents(spark, sf_dir))


@query("state_page", f"WITH {INC} SELECT state, _id FROM (SELECT state, _id, row_number() OVER (PARTITION BY state ORDER BY date DESC, _id) AS rn FROM act) WHERE rn BETWEEN 6 AND 10")
def state_page(spark, sf_dir):
    return stats.state_page(views.incidents(spark, sf_dir), 2)


@query("newest_created", f"WITH {INC} SELECT _id, {DAY.format('createdAt')} AS at FROM (SELECT _id, createdAt FROM act ORDER BY createdAt DESC, _id LIMIT 10)")
def newest_created(spark, sf_dir):
    return stats.recent(views.incidents(spark, sf_dir), 10, "createdAt").select("_id", F.col("createdAt").alias("at"))


@query("recent_top5", f"WITH {INC} SELECT _id, title, {DAY.format('date')} AS date FROM act ORDER BY act.date DESC, _id LIMIT 5")
def recent_top5(spark, sf_dir):
    return stats.recent(views.incidents(spark, sf_dir), 5).select("_id", "title", "date")


@query("ticker_top8", f"WITH {INC} SELECT title, state, strftime(date, '%Y-%m-%d') AS day FROM (SELECT * FROM act ORDER BY date DESC, _id LIMIT 8)")
def ticker_top8(spark, sf_dir):
    return stats.recent(views.incidents(spark, sf_dir), 8).select("title", "state", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("ingest_counters", f"WITH {INC}, a AS (SELECT state AS region, CASE WHEN _id % 5 = 0 THEN 'error' WHEN _id % 3 = 0 THEN 'merged' ELSE 'saved' END AS action FROM inc) SELECT coalesce(region, 'TOTAL') AS region, count(*) FILTER (WHERE action = 'saved') AS saved, count(*) FILTER (WHERE action = 'merged') AS merged, count(*) FILTER (WHERE action = 'error') AS errors FROM a GROUP BY ROLLUP (region)")
def ingest_counters(spark, sf_dir):
    k = F.col("_id")
    return stats.ingest_counters(views.incidents(spark, sf_dir).select(F.col("state").alias("region"), F.when(k % 5 == 0, "error").when(k % 3 == 0, "merged").otherwise("saved").alias("action")))


# Scalar functions.


@query("levenshtein", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance, CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1.0::double ELSE (greatest(length(p_name), length(p_type)) - levenshtein(p_name, p_type))::double / greatest(length(p_name), length(p_type)) END AS similarity FROM part")
def levenshtein(spark, sf_dir):
    return views.load(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"), text.similarity("p_name", "p_type").alias("similarity"))


def sql_words(c: str, least: int, stop: list[str], keep: str = "a-z0-9") -> str:
    listed_stop = "[" + ", ".join(f"'{w}'" for w in stop) + "]"
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^{keep}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= {least} AND NOT list_contains({listed_stop}, w)))"


def sql_overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::double ELSE len(list_intersect({a}, {b}))::double / least(len({a}), len({b})) END"


@query("keyword_overlap", f"WITH {DOC}, w AS (SELECT doc_id, {sql_words('title', 3, V.KEYWORD_STOPWORDS)} AS a, {sql_words('text', 3, V.KEYWORD_STOPWORDS)} AS b FROM doc) SELECT doc_id, len(a)::bigint AS n_title, len(b)::bigint AS n_text, {sql_overlap('a', 'b')} AS share FROM w")
def keyword_overlap(spark, sf_dir, docs=views.titled_documents):
    w = docs(spark, sf_dir).select("doc_id", text.keywords("title").alias("a"), text.keywords("text").alias("b"))
    return w.select("doc_id", F.size("a").alias("n_title"), F.size("b").alias("n_text"), text.overlap(F.col("a"), F.col("b")).alias("share"))


NORMAL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s/-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("normalize_text", f"WITH {DOC} SELECT doc_id, {NORMAL.format('text')} AS plain FROM doc")
def normalize_text(spark, sf_dir, docs=views.titled_documents):
    return docs(spark, sf_dir).select("doc_id", text.normalize_text("text").alias("plain"))


@query("tokenize", f"WITH {DOC} SELECT doc_id, array_to_string(list_filter(string_split({NORMAL.format('text')}, ' '), lambda w: length(w) >= 4 AND NOT list_contains([{', '.join(repr(w) for w in V.SOURCE_STOPWORDS)}], w)), ' ') AS tokens FROM doc")
def tokenize(spark, sf_dir, docs=views.titled_documents):
    return docs(spark, sf_dir).select("doc_id", F.concat_ws(" ", text.tokenize("text")).alias("tokens"))


TITLE = "trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\b(nigeria|nigerian|state)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("normalize_title", f"WITH {REP} SELECT event_id, {TITLE.format('title')} AS plain FROM rep")
def normalize_title(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", text.normalize_title("title").alias("plain"))


def _sql_title_tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split({TITLE.format(c)}, ' '), lambda w: length(w) > 3 AND NOT list_contains([{', '.join(repr(w) for w in V.TITLE_OVERLAP_STOPWORDS)}], w)))"


@query("title_token_overlap", f"WITH {REP}, t AS (SELECT event_id, {_sql_title_tokens('title')} AS a, {_sql_title_tokens('description')} AS b FROM rep) SELECT event_id, {sql_overlap('a', 'b')} AS share FROM t")
def title_token_overlap(spark, sf_dir):
    t = views.reports(spark, sf_dir).select("event_id", text.title_tokens("title").alias("a"), text.title_tokens("description").alias("b"))
    return t.select("event_id", text.overlap(F.col("a"), F.col("b")).alias("share"))


def sql_state(c: str) -> str:
    several = f"(regexp_matches({c}, '[/;]') OR regexp_matches(lower({c}), '\\band\\b'))"
    first = f"CASE WHEN {several} THEN coalesce(list_filter(list_transform(regexp_split_to_array({c}, '(?i)[/;]|\\s+and\\s+'), lambda p: trim(p)), lambda p: p <> '')[1], trim({c})) ELSE trim({c}) END"
    bare = f"trim(regexp_replace({first}, '(?i)\\s+state$', ''))"
    names = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in ({s.lower(): s for s in V.STATES} | V.STATE_ALIASES).items()) + "}"
    clean = f"lower(trim(regexp_replace(regexp_replace({bare}, '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')))"
    return f"CASE WHEN {c} = '' THEN 'Unknown' ELSE coalesce(({names})[lower({bare})], ({names})[{clean}], upper({bare}[1]) || {bare}[2:]) END"


@query("normalize_state", f"WITH {REP} SELECT event_id, {sql_state('state_raw')} AS state FROM rep")
def normalize_state(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", text.normalize_state("state_raw").alias("state"))


def _sql_states(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '(?i)[/;]|\\s+and\\s+'), lambda p: {sql_state('p')}), lambda p: p <> 'Unknown')"


@query("states_match", f"WITH {REP} SELECT event_id, state_raw <> '' AND state_other <> '' AND ({sql_state('state_raw')} = {sql_state('state_other')} OR list_has_any({_sql_states('state_raw')}, {_sql_states('state_other')})) AS same FROM rep")
def states_match(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", text.states_match("state_raw", "state_other").alias("same"))


@query("group_by_state_new", f"WITH {REP}, s AS (SELECT {sql_state('state_raw')} AS state FROM rep) SELECT state, count(*) AS n FROM s WHERE state <> 'Unknown' GROUP BY state")
def group_by_state_new(spark, sf_dir):
    return views.reports(spark, sf_dir).select(text.normalize_state("state_raw").alias("state")).where("state <> 'Unknown'").groupBy("state").agg(F.count("*").alias("n"))


@query("town_overlap", """WITH p AS (SELECT event_id, (['Garga (near Wanka)', 'Dutsin Dan Ajiya (Tungan Dutse)', '', 'Anka', 'Magazu'])[event_id % 5 + 1] AS a, (['Wanka, Kyaram, Gyambau', 'Tungan Dutse', 'x', 'Ankaa', 'Bukkuyum'])[(event_id // 5) % 5 + 1] AS b FROM events),
l AS (SELECT event_id, lower(a) AS a, lower(b) AS b FROM p), t AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(a, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('near', 'and', 'the', 'from', 'area', 'along', 'road')) AS wa,
list_filter(regexp_split_to_array(regexp_replace(b, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('near', 'and', 'the', 'from', 'area', 'along', 'road')) AS wb,
trim(regexp_replace(a, '\\s*\\(.*\\)\\s*', '', 'g')) AS pa, trim(regexp_replace(b, '\\s*\\(.*\\)\\s*', '', 'g')) AS pb, trim(regexp_extract(a, '\\(([^)]+)\\)', 1)) AS qa, trim(regexp_extract(b, '\\(([^)]+)\\)', 1)) AS qb FROM l),
x AS (SELECT *, unnest(list_filter([pa, qa], lambda v: v <> '')) AS va FROM t), y AS (SELECT *, unnest(list_filter([pb, qb], lambda v: v <> '')) AS vb FROM x),
z AS (SELECT event_id, bool_or(contains(va, vb) OR contains(vb, va) OR (greatest(length(va), length(vb)) - levenshtein(va, vb))::double / greatest(length(va), length(vb)) > 0.75) AS near FROM y GROUP BY event_id)
SELECT event_id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR list_has_any(wa, wb) OR coalesce(near, false)) AS same FROM t LEFT JOIN z USING (event_id)""")
def town_overlap(spark, sf_dir):
    k = F.col("event_id")
    a = views.pick(["Garga (near Wanka)", "Dutsin Dan Ajiya (Tungan Dutse)", "", "Anka", "Magazu"], k)
    b = views.pick(["Wanka, Kyaram, Gyambau", "Tungan Dutse", "x", "Ankaa", "Bukkuyum"], F.floor(k / 5))
    return views.load(spark, sf_dir, "events").select(k, a.alias("a"), b.alias("b")).select("event_id", text.towns_overlap("a", "b").alias("same"))


@query("is_unknown_location", f"WITH {REP}, {INC} SELECT _id, lower(trim(town)) IN ('', 'unknown', 'n/a', 'unspecified') AS no_town, lower(trim(lga)) IN ('', 'unknown', 'n/a', 'unspecified') AS no_lga FROM inc")
def is_unknown_location(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("_id", text.is_unknown_place("town").alias("no_town"), text.is_unknown_place("lga").alias("no_lga"))


@query("sanitize", "SELECT event_id, trim(regexp_replace(regexp_replace(props, '[${}]', '', 'g'), '[\\x00-\\x1f\\x7f]', '', 'g'))[1:5000] AS plain FROM events")
def sanitize(spark, sf_dir):
    return views.load(spark, sf_dir, "events").select("event_id", text.sanitize("props").alias("plain"))


SQL_HASH = f"""sha256(concat_ws('|', strftime(date, '%Y-%m-%d'), lower({sql_state('state')}), CASE WHEN lower(trim(town)) IN ('', 'unknown') OR starts_with(lower(trim(town)), 'unknown ') THEN lower(trim(CASE WHEN lga = '' THEN 'unknown' ELSE lga END)) ELSE lower(trim(town)) END, lower(trim("group"))))"""


@query("attack_hash", f"WITH {INC} SELECT _id, {SQL_HASH} AS hash FROM inc")
def attack_hash(spark, sf_dir):
    return ingest.with_hash(views.incidents(spark, sf_dir)).select("_id", "hash")


@query("truncate", f"WITH {DOC} SELECT doc_id, text[1:200] || '...' AS short FROM doc")
def truncate(spark, sf_dir, docs=views.titled_documents):
    return docs(spark, sf_dir).select("doc_id", text.truncated("text").alias("short"))


@query("location_label", f"WITH {INC} SELECT _id, concat_ws(', ', nullif(town, 'Unknown'), nullif(lga, 'Unknown'), state) AS label FROM inc")
def location_label(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("_id", text.location_label("town", "lga", "state").alias("label"))


@query("source_label", f"WITH {REP} SELECT event_id, coalesce(nullif(publisher, ''), nullif(title, ''), 'Source') AS label FROM rep")
def source_label(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", text.source_label("publisher", "title").alias("label"))


# Addresses and pages.

DOMAIN = "coalesce(regexp_replace(lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', ''), '')"
PATH = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"


@query("extract_domain", f"SELECT page_id, {DOMAIN.format('url')} AS domain FROM pages")
def extract_domain(spark, sf_dir):
    return views.load(spark, sf_dir, "pages").select("page_id", urls.extract_domain("url").alias("domain"))


@query("root_domain", f"WITH p AS (SELECT page_id, string_split({DOMAIN.format('url')}, '.') AS parts FROM pages) SELECT page_id, array_to_string(CASE WHEN len(parts) > 2 THEN parts[-2:] ELSE parts END, '.') AS root FROM p")
def root_domain(spark, sf_dir):
    return views.load(spark, sf_dir, "pages").select("page_id", urls.root_domain(urls.extract_domain("url")).alias("root"))


def sql_usable(c: str) -> str:
    domain, path, assets = DOMAIN.format(c), PATH.format(c), "|".join(e[1:] for e in V.ASSET_EXTENSIONS)
    return f"regexp_matches(lower({c}), '^https?://') AND {domain} NOT IN ('', '{V.REDIRECTOR_HOST}') AND NOT (ends_with({domain}, 'google.com') AND starts_with({path}, '/search')) AND length({path}) >= 3 AND NOT regexp_matches({path}, '\\.({assets})$')"


@query("is_usable_url", f"WITH {REP} SELECT event_id, {sql_usable('url')} AS ok FROM rep")
def is_usable_url(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", urls.is_usable_url("url").alias("ok"))


@query("static_invalid_reason", f"""WITH {REP} SELECT event_id, CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'unparseable URL' WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'non-http protocol' WHEN contains(url, 'vertexaisearch.cloud.google.com') THEN 'expired grounding link'
WHEN ends_with({DOMAIN.format('url')}, 'google.com') AND starts_with({PATH.format('url')}, '/search') THEN 'search page' WHEN length({PATH.format('url')}) < 3 THEN 'homepage (no article path)'
WHEN regexp_matches({PATH.format('url')}, '\\.({'|'.join(e[1:] for e in V.MORE_ASSET_EXTENSIONS)})$') THEN 'non-article file (' || regexp_extract({PATH.format('url')}, '\\.[^.]*$') || ')' END AS reason FROM rep""")
def static_invalid_reason(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", urls.invalid_reason("url").alias("reason"))


@query("normalize_url", f"WITH {REP} SELECT event_id, regexp_replace(lower(trim(url)), '/$', '') AS url FROM rep")
def normalize_url(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", urls.normalize_url("url").alias("url"))


def sql_any(c: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{n.lower()}')" for n in needles) + ")"


SQL_BANNED = f"({sql_any('lower(publisher)', V.BANNED_SOURCES)} OR {sql_any('lower(url)', V.BANNED_SOURCES)})"
SQL_DOMAINS = "(" + ", ".join(f"'{d}'" for d in V.TRUSTED_DOMAINS) + ")"
SQL_TRUSTED = f"""({DOMAIN.format('url')} IN {SQL_DOMAINS} OR (len(string_split({DOMAIN.format('url')}, '.')) > 2 AND array_to_string(string_split({DOMAIN.format('url')}, '.')[-2:], '.') IN {SQL_DOMAINS}) OR {sql_any('lower(publisher)', V.TRUSTED_PUBLISHERS)})"""


@query("is_trusted_source", f"WITH {REP} SELECT event_id, NOT {SQL_BANNED} AND {SQL_TRUSTED} AS ok FROM rep")
def is_trusted_source(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", urls.is_trusted_source("url", "publisher").alias("ok"))


@query("semi_trusted", f"WITH {REP} SELECT DISTINCT url, publisher FROM rep WHERE {SQL_TRUSTED}")
def semi_trusted(spark, sf_dir):
    return views.reports(spark, sf_dir).where(urls.is_trusted_source("url", "publisher", banned=["\0"])).select("url", "publisher").distinct()


@query("anti_banned", f"WITH {REP} SELECT DISTINCT url, publisher FROM rep WHERE NOT {SQL_BANNED}")
def anti_banned(spark, sf_dir):
    bad = text.holds_any(F.lower("publisher"), V.BANNED_SOURCES) | text.holds_any(F.lower("url"), V.BANNED_SOURCES)
    return views.reports(spark, sf_dir).where(~bad).select("url", "publisher").distinct()


@query("html_title", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?i)&amp;', '&', 'g'), '\\s+', ' ', 'g'))[1:300] AS title FROM pages")
def html_title(spark, sf_dir):
    return views.load(spark, sf_dir, "pages").select("page_id", urls.html_title("html").alias("title"))


@query("url_date", f"WITH {REP}, d AS (SELECT event_id, try_cast(regexp_replace(regexp_extract(url, '20\\d\\d[/-]\\d\\d[/-]\\d\\d'), '/', '-', 'g') AS date) AS d FROM rep) SELECT event_id, CASE WHEN year(d) BETWEEN 2015 AND 2101 THEN strftime(d, '%Y-%m-%d') || ' 12:00:00' END AS at FROM d")
def url_date(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", urls.url_date("url").alias("at"))


@query("published_date")
def published_date(spark, sf_dir):
    return views.load(spark, sf_dir, "pages").select("page_id", urls.published_date("html", "url").alias("at"))


@query("source_relevant")
def source_relevant(spark, sf_dir):
    r = views.reports(spark, sf_dir).repartition("event_id").withColumn("places", urls.location_tokens("state_raw", F.lit(""), F.lit("Jos")))
    r = r.withColumn("meaning", urls.semantic_tokens("title", F.lit("bandits"), "description", F.col("places")))
    r = r.withColumn("relevant", urls.source_relevant(F.col("places"), F.col("meaning"), "title", "url"))
    return r.select("event_id", "relevant", urls.chunk_score("title", "publisher", "description", "url", F.col("relevant")).alias("score"))


@query("http_verdict")
def http_verdict(spark, sf_dir):
    pages = views.load(spark, sf_dir, "pages").select("page_id", "url", F.element_at(F.array(F.lit(200), F.lit(404), F.lit(503), F.lit(None).cast("int")), (F.col("page_id") % 4 + 1).cast("int")).alias("status"), F.when(F.col("page_id") % 8 == 0, "image/png").otherwise("text/html; charset=utf-8").alias("content_type"), F.lit(None).cast("string").alias("final_url"))
    return pages.select("page_id", urls.http_verdict("status", "content_type", "url", "final_url").alias("reason"))


# Dates.

_MONTHS = "(" + "|".join(V.MONTHS) + ")"
_D, _Y = "(\\d{1,2})(?:st|nd|rd|th)?", "(?:,\\s*|\\s+)(20\\d{2})\\b"
_PATTERNS = [(f"(?i)\\b(?:On\\s+)?{_MONTHS}\\s+{_D}\\s*(?:or|/|-)\\s*{_D}{_Y}", 1, 2, 4), (f"(?i)\\bOn\\s+{_MONTHS}\\s+{_D}{_Y}", 1, 2, 3), (f"(?i)\\b(?:On\\s+)?{_MONTHS}\\s+{_D}{_Y}", 1, 2, 3), (f"(?i)\\b(?:On|Since)\\s+(\\d{{1,2}})\\s+{_MONTHS}{_Y}", 2, 1, 3)]


def sql_narrative(c: str) -> str:
    months = "MAP {" + ", ".join(f"'{m.lower()}': {i}" for i, m in enumerate(V.MONTHS, 1)) + "}"
    one = []
    for p, m, d, y in _PATTERNS:
        day, year = f"try_cast(regexp_extract({c}, '{p}', {d}) AS int)", f"try_cast(regexp_extract({c}, '{p}', {y}) AS int)"
        one.append(f"CASE WHEN {day} BETWEEN 1 AND 31 AND {year} BETWEEN 2015 AND 2101 THEN make_date({year}, ({months})[lower(regexp_extract({c}, '{p}', {m}))], 1) + ({day} - 1) END")
    return f"coalesce({', '.join(one)})"


@query("narrative_date", f"WITH {REP} SELECT event_id, strftime({sql_narrative('description')}, '%Y-%m-%d') || ' 12:00:00' AS at FROM rep")
def narrative_date(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", dates.narrative_date("description").alias("at"))


HINTED = "h AS (SELECT _id, date, date + to_days((_id % 80)::int) AS hint FROM inc)"


def _hinted(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("_id", "date", (F.col("date") + F.make_interval(days=(F.col("_id") % 80).cast("int"))).alias("hint"))


@query("reconcile_date", f"WITH {INC}, {HINTED} SELECT _id, {DAY.format('CASE WHEN _id % 80 BETWEEN 7 AND 60 THEN hint ELSE date END')} AS at FROM h")
def reconcile_date(spark, sf_dir):
    return _hinted(spark, sf_dir).select("_id", dates.reconcile(F.col("date"), F.col("hint")).alias("at"))


@query("date_fix", f"WITH {INC}, {HINTED} SELECT _id, {DAY.format('hint')} AS at FROM h WHERE _id % 80 BETWEEN 7 AND 60 AND month(date) <> month(hint)")
def date_fix(spark, sf_dir):
    return _hinted(spark, sf_dir).select("_id", dates.date_fix(F.col("date"), F.col("hint")).alias("at")).where("at IS NOT NULL")


@query("parse_loose_date", f"WITH {INC}, y AS (SELECT _id, date + to_years((_id % 40)::int) AS d FROM inc) SELECT _id, CASE WHEN year(d) BETWEEN 2015 AND 2031 THEN {DAY.format('d')} END AS at FROM y")
def parse_loose_date(spark, sf_dir):
    d = F.col("date") + F.make_interval(years=(F.col("_id") % 40).cast("int"))
    return views.incidents(spark, sf_dir).select("_id", dates.loose_date(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), 2030).alias("at"))


@query("day_window", f"SELECT event_id, {DAY.format(chr(39).join(['date_trunc(', 'day', ', ts) - INTERVAL 2 DAY']))} AS first, {DAY.format(chr(39).join(['date_trunc(', 'day', ', ts) + INTERVAL 3 DAY']))} AS last FROM events")
def day_window(spark, sf_dir):
    first, last = dates.day_window(F.col("ts").cast("timestamp"), 2)
    return views.load(spark, sf_dir, "events").select("event_id", first.alias("first"), last.alias("last"))


@query("month_windows", f"""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::date AS m FROM orders), l AS (SELECT m, least(last_day(m), DATE '{AS_OF.date()}') AS l FROM m),
s AS (SELECT m, l, unnest(generate_series(m::timestamp, l::timestamp, INTERVAL 14 DAY))::date AS f FROM l) SELECT strftime(m, '%Y-%m-%d') AS month, strftime(f, '%Y-%m-%d') AS first, strftime(least(f + 13, l), '%Y-%m-%d') AS last FROM s""")
def month_windows(spark, sf_dir):
    m = views.load(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return m.select("month", F.explode(dates.month_windows(F.col("month"), F.lit(AS_OF.date()))).alias("w")).select("month", "w.first", "w.last")


@query("anchor_dates", "WITH c AS (SELECT c_custkey, DATE '2026-01-01' AS a, DATE '2026-01-01' + (c_custkey % 30)::int AS b FROM customer), s AS (SELECT c_custkey, unnest(list_distinct(list_append(generate_series(a::timestamp, b::timestamp, INTERVAL 4 DAY), b::timestamp))) AS d FROM c) SELECT c_custkey, strftime(d, '%Y-%m-%d') AS day FROM s")
def anchor_dates(spark, sf_dir):
    first = F.lit(dt.date(2026, 1, 1))
    return views.load(spark, sf_dir, "customer").select("c_custkey", F.explode(dates.anchor_dates(first, F.date_add(first, (F.col("c_custkey") % 30).cast("int")))).alias("day"))


@query("month_options", "WITH c AS (SELECT c_custkey, unnest(generate_series(TIMESTAMP '2026-01-01', TIMESTAMP '2026-01-01' + to_months((c_custkey % 7)::int), INTERVAL 1 MONTH)) AS m FROM customer) SELECT c_custkey, strftime(m, '%Y-%m') AS month FROM c")
def month_options(spark, sf_dir):
    first = F.lit(dt.date(2026, 1, 1))
    return views.load(spark, sf_dir, "customer").select("c_custkey", F.explode(dates.month_options(first, F.add_months(first, (F.col("c_custkey") % 7).cast("int")))).alias("month"))


@query("time_since", "WITH s AS (SELECT event_id, greatest(0, (epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) // 1000000) AS s FROM events) SELECT event_id, s // 86400 AS days, s % 86400 // 3600 AS hours, s % 3600 // 60 AS minutes, s % 60 AS seconds FROM s")
def time_since(spark, sf_dir):
    t = dates.time_since(F.col("ts").cast("timestamp"), F.lit(dt.datetime(2024, 1, 20, 12)))
    return views.load(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", "t.*")


@query("date_proximity", f"WITH {INC} SELECT _id, CASE WHEN _id % 6 < 1 THEN 0.1::double WHEN _id % 6 < 2 THEN 0.05::double ELSE 0.0::double END AS score FROM inc")
def date_proximity(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("_id", score.date_proximity(F.col("date"), F.col("createdAt")).alias("score"))


# Counts.


@query("total_affected", f"WITH {INC} SELECT _id, coalesce(killed, 0) + coalesce(injured, 0) + coalesce(kidnapped, 0) AS total FROM inc")
def total_affected(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("_id", filters.total_affected().alias("total"))


@query("merge_count", f"WITH {INC} SELECT _id, greatest(killed, injured) AS keep, coalesce(greatest(killed, injured), 0) AS zero, nullif(greatest(killed, injured), 0) AS blank FROM inc")
def merge_count(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("_id", *[merge.merge_count(F.col("killed"), F.col("injured"), p).alias(p) for p in ("keep", "zero", "blank")])


SQL_CASUALTY = "CASE WHEN coalesce({0}, 0) = 0 AND coalesce({1}, 0) = 0 THEN 0.1::double WHEN coalesce({0}, 0) = 0 OR coalesce({1}, 0) = 0 THEN 0.05::double WHEN least({0}, {1})::double / greatest({0}, {1}) > 0.5 THEN 0.2::double WHEN least({0}, {1})::double / greatest({0}, {1}) > 0.3 THEN 0.1::double ELSE 0.0::double END"


@query("casualty_score", f"WITH {INC} SELECT _id, {SQL_CASUALTY.format('killed', 'injured')} AS score FROM inc")
def casualty_score(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("_id", score.casualty_score(F.col("killed"), F.col("injured")).alias("score"))


COUNTS_SEEN = ["{n}", " {n} people", "+{n}", "-{n}", "about {n}", "{n}.7", "", "1e3", "99999999999", "\t{n}\n", "none", "{n},000"]


@query("sanitize_casualty", f"""WITH {INC}, w AS (SELECT _id, replace({views.sql_pick(COUNTS_SEEN, '_id // 4')}, '{{n}}', coalesce(killed, 0)::varchar) AS written FROM inc), p AS (SELECT _id, regexp_extract(written, '^\\s*([+-]?\\d+)', 1) AS digits FROM w)
SELECT _id, try_cast(digits AS int) AS n FROM p""")
def sanitize_casualty(spark, sf_dir):
    """Counts as models write them: signs, words around, fractions, none, and one past what a whole number holds."""
    written = F.replace(views.pick(COUNTS_SEEN, F.floor(F.col("_id") / 4)), F.lit("{n}"), F.coalesce(F.col("killed"), F.lit(0)).cast("string"))
    return views.incidents(spark, sf_dir).select("_id", text.whole_count(written).alias("n"))


@query("status_upgrade", f"WITH {INC} SELECT _id, CASE WHEN _id % 4 = 0 THEN 'confirmed' ELSE status END AS status FROM inc")
def status_upgrade(spark, sf_dir):
    return views.incidents(spark, sf_dir).select("_id", merge.merge_status(F.col("status"), F.when(F.col("_id") % 4 == 0, "confirmed").otherwise("developing")).alias("status"))


@query("chart_scale", f"WITH {INC}, m AS (SELECT strftime(date, '%Y-%m') AS ym, count(*) AS a, sum(killed) AS b FROM act GROUP BY 1) SELECT greatest(5, max(a), max(b))::bigint AS top FROM m")
def chart_scale(spark, sf_dir):
    m = stats.by_year_month(views.incidents(spark, sf_dir))
    return m.agg(F.greatest(F.lit(5), F.max("incidents"), F.max("killed")).alias("top"))


# Arrays of sources.

NORM = "regexp_replace(lower(trim(url)), '/$', '')"


@query("merge_sources", f"WITH {SRC}, n AS (SELECT _id, pos, url, row_number() OVER (PARTITION BY _id, {NORM} ORDER BY pos, url) AS rn FROM src) SELECT _id, string_agg(url, ' ' ORDER BY pos, url) AS urls FROM n WHERE rn = 1 GROUP BY _id")
def merge_sources(spark, sf_dir):
    own = views.incidents(spark, sf_dir, sources=True).where(F.size("sources") > 0)
    half = F.floor(F.size("sources") / 2).cast("int")
    both = merge.merge_sources(F.slice("sources", F.lit(1), half), F.slice("sources", half + 1, F.size("sources")))
    return own.select("_id", F.concat_ws(" ", F.transform(both, lambda s: s["url"])).alias("urls"))


@query("anti_new_sources", f"WITH {SRC}, h AS (SELECT *, {NORM} AS u, pos <= 2 AS own FROM src) SELECT _id, string_agg(url, ' ' ORDER BY pos, url) AS urls FROM h WHERE NOT own AND NOT EXISTS (SELECT 1 FROM h o WHERE o._id = h._id AND o.own AND o.u = h.u) GROUP BY _id")
def anti_new_sources(spark, sf_dir):
    rows = views.source_rows(spark, sf_dir).groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("pos", "url"))).alias("s"))
    new = merge.new_sources(F.filter("s", lambda x: x["pos"] <= 2), F.filter("s", lambda x: x["pos"] > 2))
    return rows.select("_id", F.concat_ws(" ", F.transform(new, lambda x: x["url"])).alias("urls")).where("urls <> ''")


@query("merge_tags", "SELECT l_orderkey AS _id, string_agg(DISTINCT l_returnflag || l_linestatus, ' ' ORDER BY l_returnflag || l_linestatus) AS tags FROM lineitem GROUP BY 1")
def merge_tags(spark, sf_dir):
    g = views.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("t"))
    return g.select("_id", F.concat_ws(" ", F.array_sort(merge.merge_tags(F.col("t"), F.array(F.lit(""))))).alias("tags"))


@query("distinct_array", "SELECT l_orderkey AS _id, count(DISTINCT l_suppkey % 7) AS n, string_agg(DISTINCT (l_suppkey % 7)::varchar, ',' ORDER BY (l_suppkey % 7)::varchar) AS vals FROM lineitem GROUP BY 1")
def distinct_array(spark, sf_dir):
    g = views.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.array_distinct(F.collect_list((F.col("l_suppkey") % 7).cast("string"))).alias("v"))
    return g.select("_id", F.size("v").alias("n"), F.concat_ws(",", F.array_sort("v")).alias("vals"))


@query("shared_source_pairs", f"WITH {SRC}, u AS (SELECT DISTINCT _id, {NORM} AS u FROM src) SELECT a._id AS id_a, b._id AS id_b, count(*) AS shared FROM u a JOIN u b ON a.u = b.u AND a._id < b._id GROUP BY 1, 2")
def shared_source_pairs(spark, sf_dir):
    return dedup.shared_source_pairs(views.source_rows(spark, sf_dir))


# The classes themselves: with them, all pairs are told by membership.
@query("shared_source_classes", f"WITH {SRC}, u AS (SELECT DISTINCT _id, {NORM} AS source FROM src) SELECT _id, source, min(_id) OVER (PARTITION BY source) AS class_id, count(*) OVER (PARTITION BY source) AS members FROM u")
def shared_source_classes(spark, sf_dir):
    return dedup.shared_source_classes(views.source_rows(spark, sf_dir))


@query("valid_split", f"WITH {REP} SELECT event_id % 100 AS _id, count(*) FILTER (WHERE {sql_usable('url')}) AS valid, count(*) FILTER (WHERE NOT ({sql_usable('url')})) AS removed FROM rep GROUP BY 1")
def valid_split(spark, sf_dir):
    ok = urls.is_usable_url("url")
    return views.reports(spark, sf_dir).groupBy((F.col("event_id") % 100).alias("_id")).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("removed"))


@query("fix_sources")
def fix_sources(spark, sf_dir):
    return repair.fix_sources(views.incidents(spark, sf_dir, sources=True)).select("_id", "action", F.size("sources").alias("n"))


# Classifiers.

LOWER = "lower(title || ' ' || description)"
_ops, _only = classify.ops_patterns(oracle=True), classify.attacker_patterns(oracle=True)


@query("classify_ops_update", f"WITH {REP}, c AS (SELECT *, {LOWER} AS c FROM rep) SELECT event_id, regexp_matches(c, '{_ops['force']}') AND regexp_matches(c, '{_ops['verb']}') AND NOT (regexp_matches(c, '{_ops['victim']}') AND regexp_matches(c, '{_ops['harm']}')) AND NOT regexp_matches(lower(title), '{_ops['title']}') AS flagged FROM c")
def classify_ops_update(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", classify.is_operational_update().alias("flagged"))


@query("classify_attacker_only", f"""WITH {REP}, c AS (SELECT *, {LOWER} AS c FROM rep), f AS (SELECT *, regexp_matches(c, '{_only['near']}') OR (regexp_matches(c, '{_only['role']}') AND regexp_matches(c, '{_only['harm']}')) OR regexp_matches(lower(title), '{_only['active']}') AS keep,
regexp_matches(c, '{_only['force']}') AS force, regexp_matches(c, '{_only['deaths']}') AS deaths, regexp_matches(c, '{_only['rescue']}') AS rescue, try_cast(regexp_extract(c, '{_only['count']}', 2) AS int) AS n FROM c)
SELECT event_id, CASE WHEN keep THEN NULL WHEN force AND deaths THEN 'operation' WHEN force AND rescue AND (coalesce(killed, 0) > 0 OR coalesce(injured, 0) > 0) AND coalesce(kidnapped, 0) = 0 AND displaced = 0 THEN 'rescue'
WHEN deaths AND n IS NOT NULL AND coalesce(killed, 0) > 0 AND killed <= n + 5 THEN 'count' END AS reason FROM f""")
def classify_attacker_only(spark, sf_dir):
    return views.reports(spark, sf_dir).select("event_id", classify.attacker_only_reason().alias("reason"))


# Joins and duplicates.

SQL_STATE_DAY = "strftime(date, '%Y-%m-%d')"


def _batch(spark, sf_dir, sources: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every tenth incident as a raw report, the others as stored."""
    flat = views.incidents(spark, sf_dir, sources)
    return flat.where("_id % 10 = 0"), flat.where("_id % 10 <> 0")


@query("join_hash_lookup", f"""WITH {INC}, h AS (SELECT _id, {SQL_HASH} AS h FROM inc), r AS (SELECT * FROM h WHERE _id % 10 = 0), s AS (SELECT * FROM h WHERE _id % 10 <> 0 UNION ALL SELECT _id + 1000000000, h FROM r WHERE _id % 20 = 0), m AS (SELECT h, min(_id) AS m FROM s GROUP BY h)
SELECT r._id AS raw_id, m.m AS match_id FROM r LEFT JOIN m USING (h)""")
def join_hash_lookup(spark, sf_dir):
    """Raw reports looked up by content hash; every other one is stored too, under another id."""
    raw, stored = _batch(spark, sf_dir)
    again = raw.where("_id % 20 = 0").withColumn("_id", F.col("_id") + 1_000_000_000)
    return ingest.hash_matches(ingest.with_hash(raw), ingest.with_hash(stored.unionByName(again)))


def _sql_ingest_words(c: str, least: int, stop: list[str]) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= {least} AND NOT list_contains([{', '.join(repr(w) for w in stop)}], w))"


@query("join_narrow_fuzzy", f"""WITH {INC}, r AS (SELECT *, {_sql_ingest_words('town', 3, ingest.TOWN_STOPWORDS)} AS tw, ({_sql_ingest_words('title', 4, ingest.TITLE_STOPWORDS)})[1:3] AS hw FROM inc WHERE _id % 10 = 0), s AS (SELECT * FROM inc WHERE _id % 10 <> 0),
p AS (SELECT r._id AS raw_id, s._id AS match_id, row_number() OVER (PARTITION BY r._id ORDER BY s.createdAt, s._id) AS rn FROM r JOIN s ON lower(r.state) = lower(s.state) AND s.date >= date_trunc('day', r.date) - INTERVAL 2 DAY AND s.date < date_trunc('day', r.date) + INTERVAL 3 DAY
WHERE lower(s.town) = lower(r.town) OR (len(list_filter(tw, lambda w: contains(lower(s.town), w))) > 0 AND lower(s.lga) = lower(r.lga)) OR (lower(s.lga) = lower(r.lga) AND lower(s."group") = lower(r."group"))
OR coalesce(r.killed > 0 AND lower(s.lga) = lower(r.lga) AND s.killed >= floor(r.killed * 0.5) AND s.killed <= ceil(r.killed * 1.5), false) OR (len(hw) >= 2 AND len(list_filter(hw, lambda w: NOT contains(lower(s.title), w))) = 0 AND lower(s."group") = lower(r."group"))
OR coalesce(r.killed > 0 AND r.kidnapped > 0 AND lower(s."group") = lower(r."group") AND s.killed = r.killed AND s.kidnapped = r.kidnapped, false)) SELECT raw_id, match_id FROM p WHERE rn = 1""")
def join_narrow_fuzzy(spark, sf_dir):
    return ingest.narrow_matches(*_batch(spark, sf_dir))


@query("join_broad_followup", f"""WITH {INC}, r AS (SELECT *, lower(lga) <> 'unknown' AS kl, lower(town) <> 'unknown' AS kt FROM inc WHERE _id % 10 = 0), s AS (SELECT * FROM act WHERE _id % 10 <> 0),
p AS (SELECT r._id AS raw_id, s._id AS match_id, row_number() OVER (PARTITION BY r._id ORDER BY s.date, s._id) AS rn FROM r JOIN s ON lower(r.state) = lower(s.state)
WHERE coalesce(kl AND lower(s.lga) = lower(r.lga) AND r.kidnapped >= 10 AND s.kidnapped >= floor(r.kidnapped * 0.8) AND s.kidnapped <= ceil(r.kidnapped * 1.2), false) OR (kl AND kt AND lower(s.lga) = lower(r.lga) AND contains(lower(s.town), lower(r.town)))
OR coalesce(r.kidnapped >= 50 AND s.kidnapped >= floor(r.kidnapped * 0.8) AND s.kidnapped <= ceil(r.kidnapped * 1.2), false) OR coalesce(kl AND lower(s.lga) = lower(r.lga) AND r.kidnapped >= 100 AND s.kidnapped >= floor(r.kidnapped * 0.6) AND s.kidnapped <= ceil(r.kidnapped * 1.4), false)
OR (kt AND lower(s.town) = lower(r.town) AND lower(s."group") = lower(r."group") AND abs(epoch_ms(s.date) - epoch_ms(r.date)) <= 60 * 86400000::bigint)) SELECT raw_id, match_id FROM p WHERE rn = 1""")
def join_broad_followup(spark, sf_dir):
    return ingest.broad_matches(*_batch(spark, sf_dir))


BORDER = "b AS (SELECT * EXCLUDE (town), 'Town ' || (_id % 50) AS town, _id % 10 = 0 AS raw FROM inc)"


def _border(spark, sf_dir) -> DataFrame:
    return views.incidents(spark, sf_dir, sources=True).withColumn("town", F.concat(F.lit("Town "), (F.floor(F.col("_id") / 1) % 50).cast("string")))


@query("join_cross_state", f"""WITH {INC}, {SRC}, b AS (SELECT * EXCLUDE (town), 'Town ' || (_id % 50) AS town FROM inc), r AS (SELECT * FROM b WHERE _id % 4 = 0), s AS (SELECT * FROM b WHERE _id % 4 <> 0 AND NOT coalesce(_deleted, false)), u AS (SELECT DISTINCT _id, {NORM} AS u FROM src),
p AS (SELECT r._id AS raw_id, s._id AS match_id, row_number() OVER (PARTITION BY r._id ORDER BY s.createdAt, s._id) AS rn, coalesce(r.killed >= 50 AND s.killed >= floor(r.killed * 0.8) AND s.killed <= ceil(r.killed * 1.2) AND r.kidnapped IS NOT DISTINCT FROM s.kidnapped, false) AS big FROM r JOIN s ON lower(r.town) = lower(s.town) AND lower(r.state) <> lower(s.state) AND abs(date_diff('day', r.date, s.date)) <= 1),
o AS (SELECT *, big OR EXISTS (SELECT 1 FROM u x JOIN u y ON x.u = y.u WHERE x._id = raw_id AND y._id = match_id) AS ok FROM p WHERE rn <= 10) SELECT raw_id, arg_min(match_id, rn) AS match_id FROM o WHERE ok GROUP BY raw_id""")
def join_cross_state(spark, sf_dir):
    b = _border(spark, sf_dir)
    return ingest.cross_state_matches(b.where("_id % 4 = 0"), b.where("_id % 4 <> 0"))


def sql_similarity(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::double ELSE (greatest(length({a}), length({b})) - levenshtein({a}, {b}))::double / greatest(length({a}), length({b})) END"


_vague = lambda c: sql_any(c, V.VAGUE_GROUPS)
TOWNS, LGAS = ["Garga", "Wanka", "Unknown", "Gargaru", "Tungan Dutse", "Wankama"], ["Kanam", "Unknown", "Anka", "Kanamma"]
#: Documents as incidents of a source on a day, with towns, LGAs and one address each; the text as title and description.
DOC_INC = f"""d AS (SELECT doc_id AS _id, title, text AS description, source AS state, TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::int) AS date, CASE WHEN doc_id % 3 = 0 THEN 'bandits' WHEN doc_id % 3 = 1 THEN 'militants' ELSE 'herders' END AS "group", (doc_id % 40)::int AS killed,
lower({views.sql_pick(TOWNS, 'doc_id // 7')}) AS town, lower({views.sql_pick(LGAS, 'doc_id // 5')}) AS lga, doc_id % 50 AS url FROM doc),
f AS (SELECT *, {sql_words('title', 3, V.KEYWORD_STOPWORDS)} AS tw, {sql_words('description', 3, V.KEYWORD_STOPWORDS)} AS dw, lower(title) AS t FROM d)"""
_town, _lga, _known = sql_similarity("a.town", "b.town"), sql_similarity("a.lga", "b.lga"), "(a.lga <> 'unknown' AND b.lga <> 'unknown')"
SQL_PLACE = f"""CASE WHEN a.town <> 'unknown' AND b.town <> 'unknown' THEN CASE WHEN contains(a.town, b.town) OR contains(b.town, a.town) OR {_town} > 0.75 THEN 0.4::double WHEN {_town} > 0.5 THEN 0.2::double ELSE 0.0::double END WHEN {_known} AND {_lga} > 0.75 THEN 0.3::double ELSE 0.0::double END"""
SQL_LOCATION = f"""CASE WHEN {SQL_PLACE} > 0 THEN CASE WHEN {_known} AND {_lga} > 0.75 THEN least({SQL_PLACE} + 0.1::double, 0.5::double) ELSE {SQL_PLACE} END WHEN {_known} AND {_lga} > 0.85 THEN 0.25::double ELSE 0.0::double END"""
DOC_SCORE = f"""s AS (SELECT least(a._id, b._id) AS id_a, greatest(a._id, b._id) AS id_b, 0.0::double + {SQL_LOCATION} + CASE WHEN {sql_similarity('a."group"', 'b."group"')} > 0.6 THEN 0.15::double ELSE 0.0::double END + {SQL_CASUALTY.format('a.killed', 'b.killed')}
+ CASE WHEN {sql_overlap('a.tw', 'b.tw')} > 0.5 THEN 0.2::double WHEN {sql_overlap('a.tw', 'b.tw')} > 0.3 THEN 0.1::double ELSE 0.0::double END + CASE WHEN {sql_similarity('a.t', 'b.t')} > 0.85 THEN 0.25::double WHEN {sql_similarity('a.t', 'b.t')} > 0.7 THEN 0.15::double ELSE 0.0::double END
+ CASE WHEN {sql_overlap('a.dw', 'b.dw')} > 0.4 THEN 0.15::double WHEN {sql_overlap('a.dw', 'b.dw')} > 0.25 THEN 0.08::double ELSE 0.0::double END + CASE WHEN a.url = b.url THEN 0.3::double ELSE 0.0::double END + CASE WHEN a.date = b.date THEN 0.1::double WHEN abs(date_diff('day', a.date, b.date)) < 2 THEN 0.05::double ELSE 0.0::double END AS raw, round(raw, 2) AS score FROM f a JOIN f b ON a.state = b.state AND abs(date_diff('day', a.date, b.date)) <= 8 AND {{}})"""


def _doc_incidents(spark, sf_dir, docs=views.titled_documents) -> DataFrame:
    k = F.col("doc_id")
    return docs(spark, sf_dir).select(
        k.alias("_id"), "title", F.col("text").alias("description"), F.col("source").alias("state"), views.pick(LGAS, F.floor(k / 5)).alias("lga"), views.pick(TOWNS, F.floor(k / 7)).alias("town"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(days=(k % 30).cast("int"))).alias("date"), F.when(k % 3 == 0, "bandits").when(k % 3 == 1, "militants").otherwise("herders").alias("group"),
        (k % 40).cast("int").alias("killed"), *[F.lit(None).cast("int").alias(c) for c in ("injured", "kidnapped", "displaced")], F.lit("unconfirmed").alias("status"), F.array(F.struct(F.concat(F.lit("https://a.b/"), (k % 50).cast("string")).alias("url"), F.lit("").alias("title"), F.lit("").alias("publisher"))).alias("sources"), F.lit(False).alias("_deleted"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(days=(k % 30).cast("int"))).alias("createdAt"),
    )


@query("dedup_state_scan", f"WITH {DOC}, {DOC_INC}, {DOC_SCORE.format('a._id < b._id')} SELECT id_a, id_b, score FROM s WHERE raw >= 0.4")
def dedup_state_scan(spark, sf_dir, docs=views.titled_documents):
    return dedup.scan(_doc_incidents(spark, sf_dir, docs), told=False)


@query("dedup_global_scan", f"WITH {DOC}, {DOC_INC}, {DOC_SCORE.format('a._id < b._id')} SELECT id_a, id_b, score FROM s WHERE raw >= 0.6")
def dedup_global_scan(spark, sf_dir, docs=views.titled_documents):
    return dedup.scan(_doc_incidents(spark, sf_dir, docs), threshold=0.6, include_deleted=False, told=False)


@query("dedup_recent", f"WITH {DOC}, {DOC_INC}, {DOC_SCORE.format(chr(39).join(['a._id <> b._id AND a.date >= TIMESTAMP ', '2024-01-26', '']))} SELECT DISTINCT id_a, id_b, score FROM s WHERE raw >= 0.4")
def dedup_recent(spark, sf_dir, docs=views.titled_documents):
    return dedup.scan_recent(_doc_incidents(spark, sf_dir, docs), F.lit(dt.datetime(2024, 1, 26)), told=False)


@query("top_candidates", f"WITH {DOC}, {DOC_INC}, {DOC_SCORE.format('a._id < b._id')} SELECT id_a, id_b, score FROM s WHERE raw >= 0.4 ORDER BY score DESC, id_a, id_b LIMIT 5")
def top_candidates(spark, sf_dir, docs=views.titled_documents):
    return dedup.best(_doc_incidents(spark, sf_dir, docs), 5, told=False)


@query("dedup_exact_cluster", f"""WITH {DOC}, d AS (SELECT doc_id AS _id, strftime(TIMESTAMP '2024-01-01' + to_days((doc_id % 3)::int), '%Y-%m-%d') || '|' || {TITLE.format('title')} AS cluster, length(text) AS n FROM doc), c AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS members, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, _id) AS rank FROM d) SELECT _id, cluster, members, rank FROM c WHERE members > 1""")
def dedup_exact_cluster(spark, sf_dir, docs=views.titled_documents):
    rows = _doc_incidents(spark, sf_dir, docs).withColumn("date", F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(days=(F.col("_id") % 3).cast("int")))
    return dedup.exact_clusters(rows).select("_id", "cluster", "members", "rank")


# The same queries with titles as they are. Spark and DuckDB differ in edits outside ASCII, so these have no SQL.
for _f in (keyword_overlap, normalize_text, tokenize, truncate, dedup_state_scan, dedup_global_scan, dedup_recent, top_candidates, dedup_exact_cluster):
    query(f"{_f.__name__}_all")(functools.partial(_f.__wrapped__, docs=views.all_documents))


@query("dedup_cross_state_pairs", f"""WITH {INC}, {SRC}, b AS (SELECT * EXCLUDE (town, title), 'Town ' || (_id % 50) AS town, {_sql_title_tokens('title')} AS tk FROM act), u AS (SELECT DISTINCT _id, {NORM} AS u FROM src)
SELECT a._id AS id_a, b._id AS id_b FROM b a JOIN b ON lower(a.town) = lower(b.town) AND a.date::date = b.date::date AND lower(a.state) <> lower(b.state) AND a._id < b._id WHERE {sql_overlap('a.tk', 'b.tk')} >= 0.7 OR (coalesce(a.killed, 0) >= 100 AND coalesce(b.killed, 0) >= 100) OR EXISTS (SELECT 1 FROM u x JOIN u y ON x.u = y.u WHERE x._id = a._id AND y._id = b._id)""")
def dedup_cross_state_pairs(spark, sf_dir):
    return dedup.cross_state_pairs(_border(spark, sf_dir))


SQL_MERGED = f"""pair AS (SELECT a._id AS kept, b._id AS dropped FROM inc a JOIN inc b ON b._id = a._id + 1 WHERE a._id % 10 = 1), both_src AS (SELECT kept, 0 AS part, pos, url FROM pair JOIN src ON _id = kept UNION ALL SELECT kept, 1, pos, url FROM pair JOIN src ON _id = dropped),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kept, {NORM} ORDER BY part, pos, url) AS rn FROM both_src), joined AS (SELECT kept, string_agg(url, ' ' ORDER BY part, pos, url) AS urls FROM ranked WHERE rn = 1 GROUP BY kept)"""
_ONE = "SELECT a._id, {text} AS description, greatest(a.killed, b.killed) AS killed, greatest(a.injured, b.injured) AS injured, greatest(a.kidnapped, b.kidnapped) AS kidnapped, greatest(a.displaced, b.displaced) AS displaced, CASE WHEN b.status = 'confirmed' THEN 'confirmed' ELSE a.status END AS status, coalesce(urls, '') AS urls FROM pair JOIN inc a ON a._id = kept JOIN inc b ON b._id = dropped LEFT JOIN joined USING (kept)"
MERGED = ["_id", "description", "killed", "injured", "kidnapped", "displaced", "status"]


def _merge_batch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    flat = views.incidents(spark, sf_dir, sources=True)
    return flat, views.incidents(spark, sf_dir).where("_id % 10 = 1").select(F.col("_id").alias("kept"), (F.col("_id") + 1).alias("dropped"))


def _urls(c: str = "sources"):
    return F.concat_ws(" ", F.transform(c, lambda s: s["url"])).alias("urls")


@query("merge_incident", f"""WITH {INC}, {SRC}, {SQL_MERGED} {_ONE.format(text="CASE WHEN a._id % 3 = 0 THEN 'Both reports tell of one attack; the later one has the exact numbers.' ELSE a.description END")}""")
def merge_incident(spark, sf_dir):
    """Every tenth incident takes in its successor; a third have a merged description from outside, another third one that is too short."""
    flat, pairs = _merge_batch(spark, sf_dir)
    told = flat.where("_id % 3 < 2").select("_id", F.when(F.col("_id") % 3 == 0, "Both reports tell of one attack; the later one has the exact numbers.").otherwise("Both tell of one attack.").alias("text"))
    return merge.merge_pairs(flat, pairs, descriptions=told).select(*MERGED, _urls())


@query("flag_groups", f"""WITH {INC}, {SRC}, {SQL_MERGED}, m AS ({_ONE.format(text="a.description")}), l AS (SELECT _id, string_agg(url, ' ' ORDER BY pos, url) AS own FROM src GROUP BY _id)
SELECT inc._id, upper(state[1]) || state[2:] AS state, coalesce(m.killed, inc.killed) AS killed, coalesce(m.status, inc.status) AS status, coalesce(m.urls, l.own, '') AS urls, inc._id IN (SELECT dropped FROM pair) OR coalesce(_deleted, false) AS gone FROM inc LEFT JOIN m USING (_id) LEFT JOIN l USING (_id)""")
def flag_groups(spark, sf_dir):
    """Curated pairs merged, the second of each soft-deleted, states in canonical form."""
    return repair.flag_groups(*_merge_batch(spark, sf_dir)).select("_id", "state", "killed", "status", _urls(), F.coalesce("_deleted", F.lit(False)).alias("gone"))


@query("delete_by_source", f"WITH {INC}, {SRC} SELECT _id FROM inc WHERE _id NOT IN (SELECT _id FROM src WHERE publisher = 'Supplier#000000003')")
def delete_by_source(spark, sf_dir):
    return merge.delete_by_source(views.incidents(spark, sf_dir, sources=True), "Supplier#000000003").select("_id")


@query("ingest_plan")
def ingest_plan(spark, sf_dir):
    raw, stored = _batch(spark, sf_dir, sources=True)
    return ingest.plan(files.settled(raw, "reports"), files.settled(ingest.with_hash(stored), "stored"))


def _raids(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every third incident as a raw report, the others as stored, in thirty towns and with few LGAs: many reports of a batch meet each other."""
    k = F.col("_id")
    flat = views.incidents(spark, sf_dir, sources=True).withColumns({"town": F.concat(F.lit("Town "), (k % 30).cast("string")), "date": F.lit(dt.datetime(1998, 1, 1)) + F.make_interval(days=(k % 400).cast("int"))})
    return flat.where("_id % 3 = 0"), flat.where("_id % 3 <> 0")


@query("ingest_in_order")
def ingest_in_order(spark, sf_dir):
    """What becomes of each report of a batch that are taken in one after the other; tested against a pass in order."""
    raw, stored = _raids(spark, sf_dir)
    return ingest.plan_in_order(raw, files.settled(ingest.with_hash(stored), "stored"))


# Streams, run over tables.


@query("fixed_window_limit")
def fixed_window_limit(spark, sf_dir):
    return jobs.fixed_window(views.load(spark, sf_dir, "events"), 3600.0, 2)


@query("tumbling_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.windowed_counts(e).select(F.col("window.start").alias("day"), "event_type", "n")


@query("session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_counts(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sessions(e).select("user_id", F.col("session_window.start").alias("start"), "n")


# Guards, small steps and batch jobs.


@query("window_guard", f"WITH {INC} SELECT _id FROM inc WHERE date >= TIMESTAMP '1997-01-01' - INTERVAL 1 DAY AND date <= TIMESTAMP '1997-06-30' + INTERVAL 1 DAY")
def window_guard(spark, sf_dir):
    return views.incidents(spark, sf_dir).where(ingest.near_window(F.lit(dt.datetime(1997, 1, 1)), F.lit(dt.datetime(1997, 6, 30)))).select("_id")


@query("state_members", f"WITH {REP} SELECT event_id FROM rep WHERE lower({sql_state('state_raw')}) IN ('borno', 'kano', 'fct')")
def state_members(spark, sf_dir):
    return ingest.of_states(views.reports(spark, sf_dir).withColumn("state", F.col("state_raw")), ["BORNO", "Kano", "fct"]).select("event_id")


@query("fresh_sources", f"WITH {REP}, d AS (SELECT event_id, try_cast(regexp_replace(regexp_extract(url, '20\\d\\d[/-]\\d\\d[/-]\\d\\d'), '/', '-', 'g') AS date) AS d FROM rep) SELECT event_id, d IS NULL OR year(d) NOT BETWEEN 2015 AND 2101 OR d + INTERVAL 12 HOUR >= TIMESTAMP '2026-04-20' + to_days((event_id % 20)::int) - INTERVAL 21 DAY AS ok FROM d")
def fresh_sources(spark, sf_dir):
    """The date in an address is that of the source; window ends vary by report."""
    last = F.lit(dt.datetime(2026, 4, 20)) + F.make_interval(days=(F.col("event_id") % 20).cast("int"))
    return views.reports(spark, sf_dir).select("event_id", ingest.fresh(urls.url_date("url"), last).alias("ok"))


@query("civilians_only", f"WITH {INC} SELECT _id FROM inc WHERE _id % 3 <> 0")
def civilians_only(spark, sf_dir):
    flag = F.when(F.col("_id") % 3 == 0, False).when(F.col("_id") % 3 == 1, True)
    return ingest.with_civilians(views.incidents(spark, sf_dir).withColumn("civilianCasualties", flag)).select("_id")


@query("recent_48h", f"WITH {INC} SELECT _id FROM inc WHERE date >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND date < TIMESTAMP '{AS_OF}'")
def recent_48h(spark, sf_dir):
    return ingest.recent(views.incidents(spark, sf_dir), F.lit(AS_OF)).select("_id")


@query("first_matching", f"WITH {INC} SELECT _id, title FROM inc ORDER BY NOT contains(title, 'Plateau'), date, _id LIMIT 1")
def first_matching(spark, sf_dir):
    return repair.first_matching(views.incidents(spark, sf_dir), F.contains("title", F.lit("Plateau")), "date", "_id").select("_id", "title")


@query("candidates_flatten", f"WITH {DOC}, {DOC_INC}, {DOC_SCORE.format('a._id < b._id')}, w AS (SELECT DISTINCT s.* FROM s JOIN f ON f._id = s.id_a WHERE f.state IN ('src0', 'src1')) SELECT id_a, id_b, score FROM w WHERE raw >= 0.4")
def candidates_flatten(spark, sf_dir):
    docs = _doc_incidents(spark, sf_dir)
    return dedup.flattened(dedup.scan_state(docs, "src0", told=False), dedup.scan_state(docs, "src1 State", told=False))


ANSWERS = ['```json\n[{"title": "A"}]\n```', "I found no incidents.", "Here: [1, 2] and [3] so", "[]", "a ] then [ b"]


def _answers(spark, sf_dir) -> DataFrame:
    return views.load(spark, sf_dir, "events").select("event_id", views.pick(ANSWERS, F.col("event_id")).alias("text"))


SQL_ANSWERS = f"a AS (SELECT event_id, {views.sql_pick([x.replace(chr(10), ' ') for x in ANSWERS], 'event_id')} AS text FROM events)"


@query("lenient_json_array", f"WITH {SQL_ANSWERS}, p AS (SELECT event_id, replace(replace(text, '```json', ''), '```', '') AS t FROM a) SELECT event_id, CASE WHEN instr(t, '[') > 0 AND length(t) - instr(reverse(t), ']') + 1 > instr(t, '[') AND contains(t, ']') THEN substr(t, instr(t, '['), length(t) - instr(reverse(t), ']') + 2 - instr(t, '[')) ELSE '[]' END AS list FROM p")
def lenient_json_array(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", urls.lenient_json_array(F.replace("text", F.lit("\n"), F.lit(" "))).alias("list"))


@query("sliding_counts", "WITH w AS (SELECT user_id, unnest([time_bucket(INTERVAL 30 SECOND, ts), time_bucket(INTERVAL 30 SECOND, ts) - INTERVAL 30 SECOND]) AS w FROM events) SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM w GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sliding_counts(e).select("user_id", F.col("window.start").alias("start"), "n")


_REGION = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(s) for s in states)}) THEN '{r}'" for r, states in V.REGIONS.items()) + " END"


@query("reports_by_region", f"WITH {REP}, s AS (SELECT {sql_state('state_raw')} AS state FROM rep) SELECT {_REGION.format('state')} AS region, count(*) AS n FROM s GROUP BY 1")
def reports_by_region(spark, sf_dir):
    return jobs.by_region(views.reports(spark, sf_dir).withColumn("state", F.col("state_raw"))).groupBy("region").agg(F.count("*").alias("n"))


@query("resolve_redirects", f"WITH {REP} SELECT event_id, CASE WHEN url LIKE '%vertexaisearch%' THEN 'https://punchng.com/story' ELSE url END AS url FROM rep")
def resolve_redirects(spark, sf_dir):
    known = views.reports(spark, sf_dir).where(F.contains("url", F.lit("vertexaisearch"))).select("url", F.lit("https://punchng.com/story").alias("final_url"))
    return files.resolve_redirects(views.reports(spark, sf_dir), known).select("event_id", "url")


@query("state_fixes", f"WITH {REP}, s AS (SELECT event_id AS _id, state_raw AS old, {sql_state('state_raw')} AS new FROM rep) SELECT * FROM s WHERE old <> new")
def state_fixes(spark, sf_dir):
    return repair.state_fixes(views.reports(spark, sf_dir).select(F.col("event_id").alias("_id"), F.col("state_raw").alias("state")))


@query("undelete", f"WITH {INC} SELECT _id, CASE WHEN _id % 34 = 0 THEN false ELSE coalesce(_deleted, false) END AS gone FROM inc")
def undelete(spark, sf_dir):
    flat = views.incidents(spark, sf_dir)
    return merge.undelete(flat, flat.where("_id % 34 = 0")).select("_id", F.coalesce("_deleted", F.lit(False)).alias("gone"))


@query("hard_delete", f"WITH {INC} SELECT _id FROM inc WHERE _id % 7 <> 0")
def hard_delete(spark, sf_dir):
    flat = views.incidents(spark, sf_dir)
    return merge.hard_delete(flat, flat.where("_id % 7 = 0")).select("_id")


@query("update_by_id", f"WITH {INC} SELECT _id, CASE WHEN _id % 9 = 0 THEN 'confirmed' ELSE status END AS status, killed FROM inc")
def update_by_id(spark, sf_dir):
    flat = views.incidents(spark, sf_dir)
    return merge.upsert(flat, flat.where("_id % 9 = 0").withColumn("status", F.lit("confirmed"))).select("_id", "status", "killed")


@query("recover_sources", f"WITH {INC}, {SRC}, f AS (SELECT DISTINCT _id FROM src) SELECT _id, NOT (coalesce(_deleted, false) AND _id % 34 = 0 AND _id IN (SELECT _id FROM f)) AND coalesce(_deleted, false) AS gone FROM inc")
def recover_sources(spark, sf_dir):
    """Rows deleted for want of sources (every second of the deleted) come back with those found."""
    flat = views.incidents(spark, sf_dir, sources=True)
    lost = flat.withColumn("_deletedReason", F.when(F.col("_id") % 34 == 0, "Invalid sources: no replacements found").otherwise("Duplicate"))
    return repair.recover(lost, flat.select("_id", "sources")).select("_id", F.coalesce("_deleted", F.lit(False)).alias("gone"))


BAD_URLS = ["nope", "ftp://x.ng/story", "https://vertexaisearch.cloud.google.com/grounding/abc", "https://www.google.com/search?q=1", "https://x.ng/", "https://x.ng/photo.JPG", "https://x.ng/talk.mp3"]
BAD_REASONS = ["unparseable URL", "non-http protocol", "expired grounding link", "search page", "homepage (no article path)", "non-article file (.jpg)", "non-article file (.mp3)"]


def _spoilt(spark, sf_dir) -> DataFrame:
    """Incidents of which every third source, by the sum of its place and its incident's number, has an address that none can have."""
    k = F.col("_id")
    spoil = lambda s, i: F.when((k + i) % 3 == 0, s.withField("url", views.pick(BAD_URLS, F.floor((k + i) / 3)))).otherwise(s)
    return views.incidents(spark, sf_dir, sources=True).withColumn("sources", F.transform("sources", spoil))


#: Places count from 0 in the order of the line items.
SPOILT = f"""o AS (SELECT _id, row_number() OVER (PARTITION BY _id ORDER BY pos, url, title, publisher) - 1 AS i FROM src),
bad AS (SELECT _id, i, CASE WHEN (_id + i) % 3 = 0 THEN {views.sql_pick(BAD_REASONS, '(_id + i) // 3')} END AS reason FROM o)"""


@query("source_checks", f"WITH {INC}, {SRC}, {SPOILT} SELECT _id, count(*) AS n, count(reason) AS bad, coalesce(string_agg(reason, '; ' ORDER BY reason), '') AS reasons FROM bad JOIN act USING (_id) GROUP BY _id")
def source_checks(spark, sf_dir):
    checked = repair.source_checks(_spoilt(spark, sf_dir))
    return checked.groupBy("_id").agg(F.count("*").alias("n"), F.count("reason").alias("bad"), F.concat_ws("; ", F.array_sort(F.collect_list("reason"))).alias("reasons"))


#: Found sources for every fifth incident.
FOUND_URLS = [f"https://found.ng/story-{i}" for i in range(4)]


@query("fix_sources_found", f"""WITH {INC}, {SRC}, {SPOILT}, s AS (SELECT _id, count(i) AS old, count(i) FILTER (WHERE reason IS NULL) AS valid FROM act LEFT JOIN bad USING (_id) GROUP BY _id)
SELECT _id, CASE WHEN old > 0 AND valid = old THEN 'keep' WHEN valid > 0 THEN 'prune' WHEN _id % 5 = 0 THEN 'replace' ELSE 'delete' END AS action, CASE WHEN valid = 0 AND _id % 5 = 0 THEN 3 ELSE valid END AS n FROM s""")
def fix_sources_found(spark, sf_dir):
    """Incidents with sources that hold and some that do not; for those without any, every fifth has four found ones."""
    flat = _spoilt(spark, sf_dir)
    found = flat.where("_id % 5 = 0").select("_id", F.array(*[F.struct(F.lit(u).alias("url"), F.lit("").alias("title"), F.lit("").alias("publisher")) for u in FOUND_URLS]).alias("sources"))
    return repair.fix_sources(flat, found).select("_id", "action", F.size("sources").alias("n"))


def _raw_reports(spark, sf_dir) -> DataFrame:
    """Phrases over events as raw reports, each with one source."""
    r = views.reports(spark, sf_dir)
    return r.select(
        F.col("event_id").alias("_id"), "title", "description", F.col("ts").alias("date"), F.col("state_raw").alias("state"), F.lit("Unknown").alias("lga"), F.lit("Jos").alias("town"), F.lit("bandits").alias("group"),
        "killed", "injured", "kidnapped", "displaced", F.array(F.struct("url", "title", "publisher")).alias("sources"), F.lit("unconfirmed").alias("status"),
    )


@query("normalized_reports")
def normalized_reports(spark, sf_dir):
    """Raw reports made ready; tested against plain Python over its rows."""
    raw = _raw_reports(spark, sf_dir)
    pages = views.load(spark, sf_dir, "pages").select("url", F.lit(None).cast("string").alias("final_url"), "html")
    done = ingest.normalized(raw, F.lit(dt.datetime(2015, 1, 1)), F.lit(dt.datetime(2027, 1, 1)), redirects=pages.select("url", F.col("url").alias("final_url")), pages=pages)
    return done.select("_id", "state", "date", _urls())


def _chunked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Raw reports whose source is a redirect, and five chunks for each; tested against plain Python over their rows."""
    raw = _raw_reports(spark, sf_dir).withColumn("sources", F.transform("sources", lambda s: s.withField("url", F.lit("https://x.y/grounding-api-redirect/1"))))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")
    k = F.col("raw_id") * 3 + F.col("pos")
    return raw, raw.select(F.col("_id").alias("raw_id"), numbers).select("raw_id", "pos", views.pick(views.URLS_SEEN, k).alias("uri"), views.pick(views.TITLES, k).alias("title"))


@query("join_chunk_rank")
def join_chunk_rank(spark, sf_dir):
    return ingest.chunk_addresses(*_chunked(spark, sf_dir)).select("_id", _urls())


@query("join_gap_chunks")
def join_gap_chunks(spark, sf_dir):
    return ingest.gap_chunk_addresses(*_chunked(spark, sf_dir)).select("_id", _urls())


@query("join_title_chunks")
def join_title_chunks(spark, sf_dir):
    return ingest.title_chunk_addresses(*_chunked(spark, sf_dir)).select("_id", _urls())


@query("ingest_applied")
def ingest_applied(spark, sf_dir):
    """Stored incidents after a batch; tested against a pass in order."""
    raw, stored = _batch(spark, sf_dir, sources=True)
    stored = ingest.with_hash(stored.withColumn("updatedAt", F.col("createdAt")))
    out = ingest.apply(files.settled(raw, "reports"), files.settled(stored, "stored"), F.lit(AS_OF))
    return out.select("_id", "killed", "kidnapped", "status", _urls(), "hash")


def _verdicts(pair: dict) -> tuple[bool, str]:
    return (pair["id_a"] + pair["id_b"]) % 3 != 0, "existing" if pair["id_b"] % 2 else "candidate"


@query("audit_duplicates")
def audit_duplicates(spark, sf_dir):
    """The pairs that an audit asks about, with a fixed rule for the answers; tested against brute force."""
    return dedup.audit(_doc_incidents(spark, sf_dir), _verdicts, limit=12, execute=True)[1]


@query("repair_quality")
def repair_quality(spark, sf_dir):
    """What a repair of one year does; tested against plain Python over its rows."""
    flat = _border(spark, sf_dir).withColumn("title", F.concat(F.lit("Raid number "), (F.col("_id") % 40).cast("string")))
    return repair.repair_quality(flat, F.lit(dt.datetime(1996, 1, 1)), F.lit(dt.datetime(1997, 1, 1)))[1]


# The store, readers of answers and scans, and the judge.


@query("store_versions", f"WITH {INC} SELECT _id, CASE WHEN _id % 9 = 0 THEN 'confirmed' ELSE status END AS status, killed, strftime(date, '%Y-%m') AS ym FROM inc WHERE _id % 7 <> 0")
def store_versions(spark, sf_dir):
    """A store of nine tenths of the incidents after three commits: the others are inserted (twice), some are updated, some deleted."""
    flat = files.settled(ingest.with_hash(views.incidents(spark, sf_dir)).withColumn("hash", F.col("_id").cast("string")), "incidents")
    store = Store(f"{files.shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.create(flat.where("_id % 10 <> 0"))
    for _ in range(2):
        store.insert(flat.where("_id % 10 = 0"))
    store.update(flat.where("_id % 9 = 0").withColumn("status", F.lit("confirmed")))
    store.delete(flat.where("_id % 7 = 0").select("_id"))
    return store.read(spark).select("_id", "status", "killed", "ym")


@query("scan_window", f"WITH {INC} SELECT _id FROM inc WHERE date BETWEEN TIMESTAMP '1997-01-05' AND TIMESTAMP '1997-03-05'")
def scan_window(spark, sf_dir):
    return jobs.in_scan(views.incidents(spark, sf_dir), F.lit(dt.datetime(1997, 1, 5)), F.lit(dt.datetime(1997, 3, 5))).select("_id")


@query("sliding_limit")
def sliding_limit(spark, sf_dir):
    """Each hit allowed or refused by a window of a day that moves; tested against plain Python."""
    return jobs.sliding_window(views.load(spark, sf_dir, "events"), 86400.0, 2)


def _told(rows: list[dict]) -> list[dict]:
    """What a model might say to prompts: fenced JSON, or none for every fifth."""
    return [{"text": "I found no incidents." if r["event_id"] % 5 == 0 else "Here:\n```json\n" + json.dumps([{"title": r["title"], "date": "2026-02-19T00:00:00Z", "location": {"state": r["state_raw"]}, "casualties": {"killed": r["killed"]}, "sources": [{"url": r["url"]}]}]) + "\n```"} for r in rows]


@query("answered_reports", f"WITH {REP} SELECT title, state_raw AS state, killed, count(*) AS n FROM rep WHERE event_id % 5 <> 0 AND lower({sql_state('state_raw')}) IN ('borno', 'kano', 'fct') GROUP BY ALL")
def answered_reports(spark, sf_dir):
    """Prompts of one state list answered by tasks, and the reports in the answers."""
    prompts = views.reports(spark, sf_dir).select("event_id", "title", "state_raw", "killed", "url")
    found = files.parse_reports(judge.answers(prompts, _told), lenient=True).withColumn("state", F.col("location.state"))
    return ingest.of_states(found, ["Borno", "KANO", "FCT"]).groupBy("title", "state", F.col("casualties.killed").alias("killed")).agg(F.count("*").alias("n"))


PERIODS = [(dt.date(2024, 1, 1), dt.date(2024, 1, 14)), (dt.date(2024, 1, 15), dt.date(2024, 1, 28)), (dt.date(2024, 1, 29), dt.date(2024, 1, 31))]


@query("period_reports", f"""WITH {REP}, s AS (SELECT event_id, ts, {sql_state('state_raw')} AS state FROM rep), r AS (SELECT *, {_REGION.format('state')} AS region, ([DATE '2024-01-01', DATE '2024-01-15', DATE '2024-01-29'])[event_id % 3 + 1] AS first, ([DATE '2024-01-14', DATE '2024-01-28', DATE '2024-01-31'])[event_id % 3 + 1] AS last FROM s)
SELECT region, strftime(first, '%Y-%m-%d') AS first, count(*) AS n FROM r WHERE region IS NOT NULL AND region <> 'Southwest' AND ts >= first::timestamp - INTERVAL 1 DAY AND ts < last::timestamp + INTERVAL 2 DAY GROUP BY ALL""")
def period_reports(spark, sf_dir):
    """Reports of historical scans, written by region and window and read by a grid without one region; those away from their window go."""
    placed = jobs.by_region(views.reports(spark, sf_dir).withColumn("state", F.col("state_raw"))).where("region IS NOT NULL")
    first = F.element_at(F.array(*[F.lit(f) for f, _ in PERIODS]), (F.col("event_id") % 3 + 1).cast("int"))
    path = f"{files.shared_folder(spark)}/periods-{uuid.uuid4().hex}"
    files.write_periods(placed.select("title", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date"), "region", first.alias("first")), path)
    grid = repair.scan_grid(spark, [F.array(*[F.struct(F.lit(f).alias("first"), F.lit(z).alias("last")) for f, z in PERIODS])]).where("region <> 'Southwest'")
    return files.read_periods(spark, path, grid).groupBy("region", "first").agg(F.count("*").alias("n"))


def _asked(rows: list[dict]) -> list[dict]:
    """Verdicts by a fixed rule; pairs of every eleventh first report make the question fail."""
    if any(r["id_a"] % 11 == 0 for r in rows):
        raise TimeoutError("no answer")
    return [{"is_duplicate": (r["id_a"] + r["id_b"]) % 3 != 0, "better": "existing" if r["id_b"] % 2 else "candidate"} for r in rows]


@query("judged_pairs", f"WITH {DOC}, {DOC_INC}, {DOC_SCORE.format('a._id < b._id')} SELECT id_a, id_b, id_a % 11 <> 0 AND (id_a + id_b) % 3 <> 0 AS is_duplicate, CASE WHEN id_a % 11 <> 0 AND id_b % 2 = 1 THEN 'existing' ELSE 'candidate' END AS better, id_a % 11 <> 0 AS answered FROM s WHERE raw >= 0.6")
def judged_pairs(spark, sf_dir):
    """Candidates with verdicts that tasks ask for; where asking fails there is none."""
    return judge.verdicts(dedup.scan(_doc_incidents(spark, sf_dir), threshold=0.6, told=False), _asked, tries=2)


@query("greedy_pairs")
def greedy_pairs(spark, sf_dir):
    """All candidates taken best first, without a limit; tested against taking them one by one."""
    pairs = dedup.scan(_doc_incidents(spark, sf_dir), threshold=0.6, told=False)
    told = judge.verdicts(pairs, _asked, tries=1)
    return dedup.greedy(pairs.join(told, ["id_a", "id_b"])).select("id_a", "id_b", "score", "kept", "dropped", "outcome")
