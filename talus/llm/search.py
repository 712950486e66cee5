"""Ranked lexical search: block-skipping over postings whose blocks are cut by dynamic programming.

The index is made of shards, each of the documents that one task read: the sorted postings of each term, and a row of its documents.
A search reads the postings of the terms it asks about. In each shard they are cut into blocks of unequal length, so that
the blocks' greatest scores bound what they hold with the least error; a query then looks at the stretches between its terms' block
ends, the best bound first, and scores only those whose bound can still reach its ten best so far.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, mapped_arrow, texts

TOP = 10
#: Documents of a shard (their numbers have 16 bits), and bytes of their texts.
SHARD_DOCS, SHARD_BYTES = 50_000, 64_000_000
#: A list is cut at ATOMS places evenly apart, or fewer; a block is of REACH such atoms at most. A further block weighs as much as an error of so many mean scores.
ATOMS, REACH, OPENING = 128, 32, 4.0
#: Terms and queries that are looked for together; more are taken in blocks.
BLOCK_TERMS = 50_000
#: Runs of letters and digits, by ASCII or beyond it, of lower-cased UTF-8.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

INDEX = "shard long, term string, n long, total long, docs binary, counts binary"
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])
_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def _cut(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values: the bytes of data between the edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * data.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


class _Shard:
    """A shard while it is made."""

    def __init__(self, number: int):
        self.number, self.vocabulary, self.rows, self.size = number, {}, [], 0

    def add(self, doc_id: int, text: str) -> None:
        terms, known = terms_of(text), self.vocabulary
        self.size += len(text)
        if terms:
            numbers = np.fromiter((known.setdefault(t, len(known)) for t in terms), dtype=np.int32, count=len(terms))
            self.rows.append((doc_id, len(terms), *np.unique(numbers, return_counts=True)))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """INDEX rows: the documents (ids and lengths, under the empty term), then the postings by term."""
        if not self.rows:
            return
        rows = sorted(self.rows, key=lambda r: r[0])
        ids, lengths = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
        yield self._batch([""], [len(rows)], [int(lengths.sum())], pa.array([ids.tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary()))
        terms = list(self.vocabulary)
        rank = np.empty(len(terms), dtype=np.int32)
        in_order = sorted(range(len(terms)), key=terms.__getitem__)
        rank[in_order] = np.arange(len(terms), dtype=np.int32)
        term = rank[np.concatenate([r[2] for r in rows])]
        doc = np.repeat(np.arange(len(rows), dtype=np.uint16), [len(r[2]) for r in rows])
        count = np.concatenate([r[3] for r in rows])
        order = np.argsort(term, kind="stable")
        doc, count = doc[order], count[order].astype(np.uint32)
        edges = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
        sums = np.add.reduceat(count.astype(np.int64), edges[:-1])
        for a in range(0, len(terms), 20_000):
            z = min(a + 20_000, len(terms))
            own, first, last = edges[a : z + 1] - edges[a], edges[a], edges[z]
            names = [terms[i].decode("utf-8", "surrogatepass") for i in in_order[a:z]]
            yield self._batch(names, np.diff(own), sums[a:z], _cut(doc[first:last], own), _cut(count[first:last], own))

    def _batch(self, terms, n, total, docs: pa.Array, counts: pa.Array) -> pa.RecordBatch:
        columns = [pa.array([self.number] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(total, pa.int64()), docs, counts]
        return pa.RecordBatch.from_arrays(columns, schema=_INDEX)


def build_index(docs: DataFrame) -> DataFrame:
    """INDEX rows of docs (doc_id, text), written to the shared folder: for each shard and term, its documents by their number in the shard and how often each has it.

    Documents without terms are left out; so are rows without doc_id. Rows that share a doc_id are documents of their own.
    """

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        shard = _Shard(number)
        for b in pieces:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard.add(doc_id, text)
                if len(shard.rows) == SHARD_DOCS or shard.size >= SHARD_BYTES:
                    yield from shard.batches()
                    number += 1
                    shard = _Shard(number)
        yield from shard.batches()

    return durable(mapped_arrow(texts(docs), run, INDEX), "postings")


def variable_blocks(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of scores the ends of its blocks: of all ways to cut it at its atoms, the one of least sum of errors (a block's greatest score less each of its scores) and of openings.

    The lists take each step of the dynamic programming together.
    """
    out: list[np.ndarray] = []
    for some in (lists[i : i + 2000] for i in range(0, len(lists), 2000)):
        sizes = [min(len(x), ATOMS) for x in some]
        width, n = max(sizes), len(some)
        most, number, total = np.zeros((width, n)), np.zeros((width + 1, n)), np.zeros((width + 1, n))
        edges = [np.arange(s + 1) * len(x) // s for x, s in zip(some, sizes, strict=True)]
        for j, (x, s, e) in enumerate(zip(some, sizes, edges, strict=True)):
            most[:s, j] = np.maximum.reduceat(x, e[:-1])
            number[: s + 1, j], number[s + 1 :, j] = e, e[-1]
            total[1 : s + 1, j] = np.cumsum(np.add.reduceat(x.astype(np.float64), e[:-1]))
        opening = np.array([OPENING * float(x.mean()) for x in some])
        cost, back = np.zeros((width + 1, n)), np.zeros((width + 1, n), dtype=np.int32)
        for i in range(1, width + 1):
            best, own, greatest = np.full(n, np.inf), np.zeros(n, dtype=np.int32), np.zeros(n)
            for j in range(i - 1, max(i - REACH, 0) - 1, -1):
                greatest = np.maximum(greatest, most[j])
                now = cost[j] + (number[i] - number[j]) * greatest - (total[i] - total[j])
                better = now < best
                best, own = np.where(better, now, best), np.where(better, j, own)
            cost[i], back[i] = best + opening, own
        for j, (s, e) in enumerate(zip(sizes, edges, strict=True)):
            ends = []
            while s:
                ends.append(int(e[s]))
                s = int(back[s, j])
            out.append(np.array(ends[::-1]))
    return out


class _Postings:
    """A term's postings in a shard: documents, scores (of weight 1), and blocks with their last document and greatest score."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, ends: np.ndarray):
        self.docs, self.scores, self.ends = docs, scores, ends
        self.begins = np.concatenate([[0], ends[:-1]])
        self.last = docs[ends - 1]
        self.first = np.concatenate([[0], self.last[:-1] + 1])
        self.most = np.maximum.reduceat(scores, self.begins)

    def among(self, wanted: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the wanted documents; blocks without one are skipped. before: how many wanted ones there are before each document."""
        use = before[self.last + 1] > before[self.first]
        begins, sizes = self.begins[use], (self.ends - self.begins)[use]
        at = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(sizes) else np.zeros(0, dtype=np.int64)
        at = at[wanted[self.docs[at]]]
        return self.docs[at], self.scores[at]


Best = tuple[np.ndarray, np.ndarray]


def best_of(ids: np.ndarray, asked: list[tuple[int, _Postings]], best: Best) -> Best:
    """best (scores, doc_ids), with what a shard (ids of its documents) has: asked are the weights and postings of a query's terms."""
    ends = np.unique(np.concatenate([p.last for _, p in asked]))
    bound = np.zeros(len(ends), dtype=np.int64)
    for w, p in asked:
        at = np.searchsorted(p.last, ends)
        inside = at < len(p.last)
        bound[inside] += w * p.most[at[inside]]
    begins = np.concatenate([[0], ends[:-1] + 1])
    order, done, step = np.argsort(-bound, kind="stable"), 0, 32
    while done < len(order):
        least = max(1, int(best[0][-1])) if len(best[0]) == TOP else 1
        some = order[done : done + step]
        # Equal to the last of the best may still be of a smaller doc_id.
        some = some[bound[some] >= least]
        if not len(some):
            break
        done, step = done + step, step * 2
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        edge[begins[some]] += 1
        np.add.at(edge, ends[some] + 1, -1)
        wanted = np.cumsum(edge[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(wanted)])
        scores = np.zeros(len(ids), dtype=np.int64)
        for w, p in asked:
            docs, own = p.among(wanted, before)
            scores[docs] += w * own
        found = np.nonzero(scores >= least)[0]
        both, named = np.concatenate([best[0], scores[found]]), np.concatenate([best[1], ids[found]])
        first = np.lexsort((named, -both))[:TOP]
        best = both[first], named[first]
    return best


def _searched(rows: DataFrame, weights: dict[str, int], items: list[tuple[int, list[str]]], n_docs: int, length: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each item in each partition of INDEX rows in order of shard and term; what a partition has found so far holds for its later shards."""

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}

        def search(shard: list[dict]) -> None:
            if len(shard) < 2:
                return
            ids, own = (np.frombuffer(shard[0][c], dtype=np.int64) for c in ("docs", "counts"))
            m = 10 + (90 * own * n_docs) // length
            lists = []
            for r in shard[1:]:
                docs, tf = np.frombuffer(r["docs"], dtype=np.uint16).astype(np.int64), np.frombuffer(r["counts"], dtype=np.uint32).astype(np.int64)
                lists.append((r["term"], docs, (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])))
            blocks = variable_blocks([s for _, _, s in lists])
            postings = {t: _Postings(d, s, e) for (t, d, s), e in zip(lists, blocks, strict=True)}
            for item, terms in items:
                asked = [(weights[t], postings[t]) for t in terms if t in postings and weights[t] > 0]
                if asked:
                    none = np.zeros(0, dtype=np.int64)
                    best[item] = best_of(ids, asked, best.get(item, (none, none)))

        shard: list[dict] = []
        for b in pieces:
            for r in b.to_pylist():
                if shard and shard[0]["shard"] != r["shard"]:
                    search(shard)
                    shard = []
                shard.append(r)
        search(shard)
        found = [(i, d, s) for i, (scores, ids) in best.items() for s, d in zip(scores.tolist(), ids.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], schema=_FOUND)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard", "term")
    return mapped_arrow(dealt, run, "item_id long, doc_id long, score long", 32_000_000)


def _blocks_of(queries: Iterable) -> Iterator[list[tuple[int, list[str]]]]:
    block, n = [], 0
    for q in queries:
        block.append((q["item_id"], q["terms"]))
        n += len(q["terms"])
        if n >= BLOCK_TERMS:
            yield block
            block, n = [], 0
    if block:
        yield block


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) of items (item_id, text): each different term once; rows that share an item_id are one item, rows without one go."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, upper.lower()).alias("t")).where("item_id IS NOT NULL")
    each = named.select("item_id", F.explode(F.regexp_extract_all("t", F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"))).alias("term"))
    return each.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of the index for each query (item_id, terms), all if there are fewer of a score above 0; equal scores by ascending doc_id.

    A document's score sums w * ((10^9 tf) div (1000 tf + 8 m)) over the query's terms, with w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    and m = 10 + (90 n N) div L. Queries are taken in blocks of BLOCK_TERMS terms, so what the driver and the tasks hold of them is
    bounded, however many there are. Items without terms, or with none that a document has, give no row; so does an empty index.
    """
    spark = index.sparkSession
    size = index.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in _blocks_of(queries.toLocalIterator()) if size["n"] else ():
        # Bounded by BLOCK_TERMS and one query more; so is the answer that comes to the driver.
        asked = spark.createDataFrame([(t,) for t in sorted({t for _, terms in block for t in terms})], "term string")
        own = durable(index.join(F.broadcast(asked), "term", "left_semi").select(index.columns), "asked-postings")
        df = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        weights = {t: math.floor(1000 * math.log((2 * size["n"] + 2) / (2 * d + 1))) for t, d in df.items()}
        items = [(i, known) for i, terms in block if (known := [t for t in terms if weights.get(t, 0) > 0])]
        rows = own.unionByName(index.where("term = ''"))
        out = out.unionByName(durable(_searched(rows, weights, items, size["n"], size["l"]), "best-by-task"))
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """search() of an index of docs (doc_id, text) for items (item_id, text). Null texts have no terms; texts of any length are taken whole; extra columns are not read."""
    return search(build_index(docs), query_terms(items))
