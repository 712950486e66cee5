"""Substring dedup: words covered by long runs of words that also start earlier, by fixed blocks as anchors.

Every window of WINDOW words holds one whole reference block: the BLOCK words from each multiple of STRIDE on. The blocks are
indexed by their hash, and the rolling windows of BLOCK words of all documents are probed against the index; a hit is a place
whose words are some document's reference block and stand elsewhere too. Hits are extended to both sides by the windows of WINDOW
words that hold them, whose first occurrences decide; runs of windows that are not the first make the maximal repeats.

Documents are dealt to pieces of a few MB by their id, once, in a table that is bucketed by piece: later passes join what they
need to the texts without moving them. Between pieces and the index only distinct hashes of a piece move, packed by range of hash:
something that all documents hold is as many entries as there are pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, give_back, shared_dir, texts
from .neardup import _mix

#: A window holds a whole block: STRIDE + BLOCK - 1 <= WINDOW.
WINDOW, BLOCK, STRIDE = 20, 8, 13
#: Characters of a piece, and of the text whose hashes one task of the index compares.
PIECE, RANGE = 4_000_000, 12_000_000

_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.empty(len(words), dtype=object)
    own[:] = words
    return pd.util.hash_array(own, categorize=False)


def run_hashes(codes: np.ndarray, size: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """64-bit hashes of the runs of `size` codes at each place that has as many from it on."""
    n = max(0, len(codes) - size + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = h * base + codes[i : i + n]
    return _mix(h)


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed planes of their bytes: what they leave unused costs nothing."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n), dtype=np.uint64)


class Piece:
    """The words of the documents of a piece, one after the other."""

    def __init__(self, docs: list[dict]):
        self.ids = np.array([d["doc_id"] for d in docs], dtype=np.int64)
        self.words = [d["text"].encode("utf-8", "surrogatepass").split() for d in docs]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.codes = word_codes([w for ws in self.words for w in ws])
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.place = np.arange(len(self.codes)) - self.begins[self.doc]

    def fits(self, size: int) -> np.ndarray:
        """Of the places of run_hashes(): those whose run ends in the document that it starts in."""
        n = max(0, len(self.codes) - size + 1)
        return self.begins[self.doc[:n] + 1] - np.arange(n) >= size

    def blocks(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, the first `bits` bits of the hash) of all rolling windows of BLOCK words."""
        at = np.nonzero(self.fits(BLOCK))[0]
        return at, run_hashes(self.codes, BLOCK)[at] >> np.uint64(64 - bits)

    def windows(self, live: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, more of the hash) of the windows of WINDOW words around hits, in order of hash, document and place, where each new hash begins, and its number."""
        at, keys = self.blocks(bits)
        found = np.searchsorted(live, keys)
        hits = at[live[np.minimum(found, len(live) - 1)] == keys] if len(live) else at[:0]
        edge = np.zeros(len(self.codes) + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(hits - (WINDOW - BLOCK), 0), 1)
        np.add.at(edge, hits + 1, -1)
        fits = self.fits(WINDOW)
        at = np.nonzero((np.cumsum(edge)[: len(fits)] > 0) & fits)[0]
        h1, h2 = (run_hashes(self.codes, WINDOW, b)[at] for b in _BASES)
        h2 >>= np.uint64(32)
        order = np.lexsort((self.place[at], self.ids[self.doc[at]], h2, h1))
        at, h1, h2 = at[order], h1[order], h2[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return at, h1, h2, new, np.cumsum(new) - 1


def _slices(keys: np.ndarray, bits: int, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, last) of sorted keys of so many bits by equal ranges of their values."""
    width = -(-(1 << bits) // ranges)
    cuts = np.searchsorted(keys, np.array([r * width for r in range(1, ranges)], dtype=np.uint64)) if ranges > 1 else []
    edges = [0, *[int(c) for c in cuts], len(keys)]
    for r, (first, last) in enumerate(zip(edges, edges[1:], strict=False)):
        if last > first:
            yield r, first, last


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df with run(row) for each row of it, one at a time: each is a piece."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for i in range(b.num_rows):
                    yield from run(b.slice(i, 1).to_pylist()[0])
        finally:
            give_back()

    return df.mapInArrow(over, schema)


PROBES = "range int, piece int, n int, data binary"
WINDOWS = "range int, piece int, n int, h1 binary, h2 binary, ids array<long>, doc binary, place binary"
KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,last:long>>"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_PROBES = pa.schema([("range", pa.int32()), ("piece", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_WINDOWS = pa.schema([*list(_PROBES)[:3], ("h1", pa.binary()), ("h2", pa.binary()), ("ids", pa.list_(pa.int64())), ("doc", pa.binary()), ("place", pa.binary())])
_FIRSTS = pa.schema([*list(_PROBES)[:3], ("data", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def probes(pieces: DataFrame, bits: int, ranges: int) -> DataFrame:
    """PROBES rows: by piece and range, the distinct hashes of its rolling windows, with two marks: a reference block, more than once here."""

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        p = Piece(row["docs"])
        at, keys = p.blocks(bits)
        own, first, counts = np.unique(keys, return_index=True, return_counts=True)
        block = np.zeros(len(own), dtype=bool)
        block[np.searchsorted(own, keys[p.place[at] % STRIDE == 0])] = True
        marked = own << np.uint64(2) | block.astype(np.uint64) << np.uint64(1) | (counts > 1).astype(np.uint64)
        yield _batch(_PROBES, [(r, row["piece"], z - a, packed_sorted(marked[a:z])) for r, a, z in _slices(own, bits, ranges)])

    return _mapped(pieces, run, PROBES)


def hits(probed: DataFrame) -> DataFrame:
    """PROBES rows: by piece and range, the hashes that are some reference block's and occur more than once."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [unpacked_sorted(d, n) for n, d in zip(rows["n"].to_pylist(), rows["data"].to_pylist(), strict=True)]
        every = np.sort(np.concatenate(parts))
        keys = every >> np.uint64(2)
        first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        size = np.diff(np.append(first, len(keys)))
        marks = np.bitwise_or.reduceat((every & np.uint64(3)).astype(np.uint8), first)
        live = keys[first][((size > 1) | (marks & 1 > 0)) & (marks & 2 > 0)]
        out = []
        for piece, p, r in zip(rows["piece"].to_pylist(), parts, rows["range"].to_pylist(), strict=True):
            own = p >> np.uint64(2)
            at = np.minimum(np.searchsorted(live, own), max(len(live) - 1, 0))
            own = own[live[at] == own] if len(live) else own[:0]
            if len(own):
                out.append((r, piece, len(own), packed_sorted(own)))
        return pa.Table.from_batches([_batch(_PROBES, out)])

    return probed.groupBy("range").applyInArrow(run, PROBES)


def _live(row: dict) -> np.ndarray:
    """The hashes that are hits in a piece, sorted: ranges come in their order."""
    parts = [unpacked_sorted(x["data"], x["n"]) for x in sorted(row["live"] or [], key=lambda x: x["range"])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def windows(joined: DataFrame, bits: int, ranges: int) -> DataFrame:
    """WINDOWS rows: by piece and range, the distinct windows around hits, each with the first document and place in the piece."""

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        p, out = Piece(row["docs"]), []
        at, h1, h2, new, _ = p.windows(_live(row), bits)
        at, h1, h2 = at[new], h1[new], h2[new]
        for r, a, z in _slices(h1, 64, ranges):
            ids, doc = np.unique(p.ids[p.doc[at[a:z]]], return_inverse=True)
            out.append((r, row["piece"], z - a, packed_sorted(h1[a:z]), packed(h2[a:z]), ids.tolist(), packed(doc), packed(p.place[at[a:z]])))
        yield _batch(_WINDOWS, out)

    return _mapped(joined, run, WINDOWS)


def later(found: DataFrame) -> DataFrame:
    """PROBES rows whose data are bits, one for each window of a piece and range in its order: 1 if it starts earlier in another piece."""

    def run(rows: pa.Table) -> pa.Table:
        n = rows["n"].to_pylist()
        h1 = np.concatenate([unpacked_sorted(d, k) for d, k in zip(rows["h1"].to_pylist(), n, strict=True)])
        h2, place = (np.concatenate([unpacked(d, k) for d, k in zip(rows[c].to_pylist(), n, strict=True)]) for c in ("h2", "place"))
        doc = np.concatenate([np.array(ids, dtype=np.int64)[unpacked(d, k).astype(np.int64)] for ids, d, k in zip(rows["ids"].to_pylist(), rows["doc"].to_pylist(), n, strict=True)])
        order = np.lexsort((place, doc, h2, h1))
        h1, h2 = h1[order], h2[order]
        gone = np.zeros(len(order), dtype=bool)
        # Pieces hold different documents, so all but the first of equal windows start later.
        gone[order[1:]] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        parts = np.split(gone, np.cumsum(n)[:-1])
        return pa.Table.from_batches([_batch(_FIRSTS, [(r, p, k, np.packbits(g).tobytes()) for r, p, k, g in zip(rows["range"].to_pylist(), rows["piece"].to_pylist(), n, parts, strict=True)])])

    return found.groupBy("range").applyInArrow(run, PROBES)


def _kept(joined: DataFrame, bits: int) -> DataFrame:
    def run(row: dict) -> Iterator[pa.RecordBatch]:
        p = Piece(row["docs"])
        at, _, _, new, number = p.windows(_live(row), bits)
        marks = [np.unpackbits(np.frombuffer(x["data"], dtype=np.uint8), count=x["n"]) for x in sorted(row["later"] or [], key=lambda x: x["range"])]
        gone = np.concatenate(marks).astype(bool)[number] if marks else np.zeros(0, dtype=bool)
        # In the piece: those after the first in order of document and place; rows of one document that tie are not after each other.
        first = at[new][number]
        gone |= (p.ids[p.doc[at]] != p.ids[p.doc[first]]) | (p.place[at] != p.place[first])
        edge = np.zeros(len(p.codes) + 1, dtype=np.int64)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + WINDOW, -1)
        over = np.cumsum(edge[:-1]) > 0
        rows = []
        for i, (doc_id, words) in enumerate(zip(p.ids.tolist(), p.words, strict=True)):
            own = over[p.begins[i] : p.begins[i + 1]]
            step = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
            spans = [{"first": a, "last": z} for a, z in zip(np.nonzero(step == 1)[0].tolist(), np.nonzero(step == -1)[0].tolist(), strict=True)]
            kept = b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g] if spans else words)
            rows.append((doc_id, len(words), int(own.sum()), kept.decode("utf-8", "surrogatepass"), spans))
            if len(rows) == 500:
                yield _batch(_KEPT, rows)
                rows = []
        yield _batch(_KEPT, rows)

    return _mapped(joined, run, KEPT)


def pieces_of(base: DataFrame, count: int) -> DataFrame:
    """(piece, docs) of base (doc_id, text): the documents of each piece in order, as a table in the shared folder that is bucketed by piece."""
    dealt = base.select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("piece"), F.struct("doc_id", "text").alias("d"))
    rows = dealt.groupBy("piece").agg(F.sort_array(F.collect_list("d")).alias("docs"))
    name = f"pieces_{uuid.uuid4().hex}"
    rows.write.bucketBy(count, "piece").option("path", f"{shared_dir(base.sparkSession)}/{name}").option("compression", "zstd").saveAsTable(name)
    return base.sparkSession.table(name)


def remove_repeats(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) of every row of docs: its words, cut at ASCII blanks and joined by single spaces, without those that repeats cover; spans are the removed runs [first, last) by word.

    A word goes if a window of WINDOW words over it also starts earlier: in a document of smaller doc_id, or further to the front of
    its own; windows are judged on the input. A null text has no words; texts of fewer than WINDOW words stay; a text of any length
    is taken whole; rows without doc_id go; of rows that share a doc_id the place alone says which is earlier, so a repeated row
    takes nothing from its like; an empty table gives an empty one; only doc_id and text are read.
    """
    base = texts(docs)
    size = base.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("rows")).first()
    count = max(1, -(-(size["chars"] + 20 * size["rows"]) // piece))
    ranges = max(1, -(-size["chars"] // RANGE))
    # Few enough bits to move, and enough that chance hits stay rare: one in some hundred places at any size.
    bits = min(62, max(24, size["chars"].bit_length() + 5))
    pieces = pieces_of(base, count)
    asked = lambda df, name: df.groupBy("piece").agg(F.collect_list(F.struct("range", "n", "data")).alias(name)).hint("shuffle_hash")
    live = durable(hits(probes(pieces, bits, ranges)), "hits")
    known = pieces.join(asked(live, "live"), "piece", "left")
    marks = durable(later(windows(known, bits, ranges)), "later-windows")
    return _kept(known.join(asked(marks, "later"), "piece", "left"), bits)
