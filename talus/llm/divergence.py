"""Source divergence audit: how the sources of a language differ in what words they use, by smoothed word shares.

Tasks count the terms of what they read; the counts are dealt by a hash of language and term to shards, where DuckDB sums them and,
in a second pass over the shards, adds up each shard's part of the distances between sources and finds its most typical terms.
Spark merges these sums and ranks. No text, and no count of a single document, is ever gathered by language or source.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, mapped_arrow

#: A term is kept in a language if as many of its documents have it; shares are of SCALE, with SMOOTHING added to each count.
LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Different terms that a task counts before it hands its counts on.
HELD = 400_000
#: Runs of letters, by ASCII or beyond it, of lower-cased UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "shard int, lang string, source string, term string, n long, head boolean"
PARTS = "lang string, source string, part string, item string, value long"

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEPT = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("head", pa.bool_())])
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

#: Counts of a shard, of the terms that enough documents of their language have; head marks one row of each term.
COUNT_SQL = f"""
WITH c AS (SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM counts GROUP BY ALL)
SELECT any_value.shard::INTEGER AS shard, lang, source, term, n::BIGINT AS n, source = min(source) OVER (PARTITION BY lang, term) AS head
FROM c, (SELECT any_value(shard) AS shard FROM counts) any_value
QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {LEAST_DOCS}"""

#: What a shard adds to the distances of sources, and its own most typical terms of each source.
PART_SQL = f"""
WITH grid AS (
    SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n, t.n AS lang_n, g.lang_total, g.kept,
        (1 + ({SCALE}::HUGEINT * (coalesce(k.n, 0) + {SMOOTHING})) // (g.total + {SMOOTHING}::HUGEINT * g.kept))::BIGINT AS p
    FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) t JOIN (SELECT DISTINCT lang, source, total, lang_total, kept FROM sources) g USING (lang) LEFT JOIN counts k ON k.lang = t.lang AND k.term = t.term AND k.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL),
typical AS (SELECT lang, source, term AS item, p - (1 + ({SCALE}::HUGEINT * (lang_n + {SMOOTHING})) // (lang_total + {SMOOTHING}::HUGEINT * kept)) AS value FROM grid WHERE n > 0)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
UNION ALL SELECT lang, item, 'pair', source, value::BIGINT FROM pairs
UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM typical WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}"""


def _asked(sql: str, schema: pa.Schema, **tables: pa.Table) -> pa.Table:
    """The answer of DuckDB about Arrow tables; what does not fit into its memory spills to a folder that goes with it."""
    import duckdb

    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": spill}) as con:
        for name, rows in tables.items():
            con.register(name, rows)
        return con.sql(sql).to_arrow_table().cast(schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNTS rows: for each language, source and term of what a task has read, its occurrences and the documents that have it; a term comes once from each task, or more often where there are very many."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, having) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                some = terms[i : i + 50_000]
                columns = [[lang] * len(some), [source] * len(some), [t.decode("utf-8", "surrogatepass") for t in some], [n[t] for t in some], [having[t] for t in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)
        held.clear()

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in pieces:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n, having = held.setdefault((lang, source), (Counter(), Counter()))
                terms = TERM.findall(text.encode("utf-8", "surrogatepass").lower())
                n.update(terms)
                having.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows(held)
        yield from rows(held)

    return mapped_arrow(read, run, COUNTS)


def kept_counts(docs: DataFrame, shards: int) -> DataFrame:
    """KEPT rows: by shard, the occurrences of the terms that LEAST_DOCS documents of their language have, for each source that has them."""
    dealt = term_counts(docs).select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "*")
    return dealt.groupBy("shard").applyInArrow(lambda rows: _asked(COUNT_SQL, _KEPT, counts=rows), KEPT)


def shard_parts(kept: DataFrame, sources: DataFrame, shards: int) -> DataFrame:
    """PARTS rows: what the terms of kept (KEPT) add to the distances of sources, and the most typical of them, from each task for all of its shards together."""
    total = [F.lit(None).cast("long").alias(c) for c in ("total", "lang_total", "kept")]
    # One row a source for each shard: as many rows as the answer has for a source, or fewer.
    told = sources.where("kept > 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "total", "lang_total", "kept")
    dealt = kept.select("shard", "lang", "source", "term", "n", *total).unionByName(told).repartition(shards, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own := [b for b in batches if b.num_rows]:
            rows = pa.Table.from_batches(own)
            of_source = rows["term"].is_null()
            yield from _asked(PART_SQL, _PARTS, counts=rows.filter(pc.invert(of_source)), sources=rows.filter(of_source)).to_batches()

    return dealt.mapInArrow(run, PARTS)


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of docs: part `pair`, its distance to each other source of the language, and part `term`, the TOP terms that it has more often than the language.

    A term's share in a group is 1 + SCALE * (count + SMOOTHING) div (all counts + SMOOTHING * kept terms), in whole numbers; a distance is
    the sum of the differences of all kept terms' shares, a term's value that to its share in the language. Ranks are by value,
    the largest first, then by item in UTF-8 order. A null lang, source or text is an empty one; each row is a document, repeated or
    not, and doc_id is not read; a group without kept terms has its pairs, of value 0 where the language has no kept term at
    all; texts of any length are taken whole; an empty table gives an empty one.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = durable(kept_counts(docs, shards), "kept-terms")
    groups = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("head").alias("kept"))
    none = F.lit(0).cast("long")
    sources = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "kept")])
    sources = durable(sources, "sources")
    found = durable(shard_parts(kept, sources, shards), "divergence-parts")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # Sources of a language without kept terms are at no distance.
    empty = sources.where("kept = 0").select("lang", "source")
    pairs = empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", none.alias("value"))
    every = sums.unionByName(pairs).unionByName(found.where("part = 'term'"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return every.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
