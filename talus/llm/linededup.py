"""Line dedup: range-partitioned line hashes with a secondary sort by document and position; first occurrences are streamed, and per-document keep bitmaps come back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mapped, mapped_arrow, texts

BLANK = b" \t\n\x0b\x0c\r"
MIN_CODE_POINTS = 10
DROP, PENDING, ANCHOR = 0, 1, 2
MARKS = "kind int, h1 long, h2 long, doc_id long, pos int"


def line_key(line: bytes) -> bytes:
    """A UTF-8 line without the blanks at its ends, A-Z lower-cased (bytes.lower leaves other letters alone)."""
    return line.strip(BLANK).lower()


def long_enough(key: bytes) -> bool:
    return len(key) >= MIN_CODE_POINTS and (len(key) >= 4 * MIN_CODE_POINTS or len(key.decode("utf-8", "surrogatepass")) >= MIN_CODE_POINTS)


def hashed_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h1, h2, doc_id, pos) of each line with a long enough key: 128 bits of hash."""
    for b in batches:
        ids, at, digests = [], [], []
        for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
            for pos, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                if long_enough(key := line_key(line)):
                    ids.append(doc_id)
                    at.append(pos)
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
        h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "doc_id": np.array(ids, dtype=np.int64), "pos": np.array(at, dtype=np.int32)})


def first_occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks of one range partition, sorted by (h1, h2, doc_id, pos).

    A key that begins inside the partition has its smallest doc_id here: its lines in later documents are DROP. The partition's
    first h1 may have begun in an earlier partition: its lines are PENDING. Its last h1 may go on in later ones: ANCHOR tells
    those the first document here.
    """
    head: int | None = None
    last: tuple[int, int, int] | None = None  # h1, h2, first doc_id of the key that the stream is in
    tail: list[tuple[int, int, int]] = []  # the keys of the h1 that the stream is in
    for b in batches:
        if not len(b):
            continue
        h1, h2, doc, pos = (b[c].to_numpy() for c in ("h1", "h2", "doc_id", "pos"))
        head = int(h1[0]) if head is None else head
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))].copy()
        if last and (int(h1[0]), int(h2[0])) == last[:2]:
            run = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(new)
            first[:run] = last[2]
        last = (int(h1[-1]), int(h2[-1]), int(first[-1]))
        same = h1 == h1[-1]
        keep = [x for x in tail if x[0] == last[0]]
        tail = list(dict.fromkeys(keep + list(zip(h1[same & (new | (np.arange(len(h1)) == 0))].tolist(), h2[same & (new | (np.arange(len(h1)) == 0))].tolist(), first[same & (new | (np.arange(len(h1)) == 0))].tolist(), strict=True))))
        pending = h1 == head
        out = pending | (doc != first)
        yield pd.DataFrame({"kind": np.where(pending[out], PENDING, DROP).astype(np.int32), "h1": h1[out], "h2": h2[out], "doc_id": doc[out], "pos": pos[out]})
    if tail and tail[0][0] != head:
        t = np.array(tail, dtype=np.int64)
        yield pd.DataFrame({"kind": np.full(len(t), ANCHOR, dtype=np.int32), "h1": t[:, 0], "h2": t[:, 1], "doc_id": t[:, 2], "pos": np.full(len(t), -1, dtype=np.int32)})


def packed(n_lines: int, drops: np.ndarray) -> bytes:
    """The keep bitmap of a document: bit i (most significant first) is 1 if line i stays; zlib-compressed."""
    bits = np.ones(n_lines, dtype=np.uint8)
    bits[drops[drops < n_lines]] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep_bitmap) of every document.

    Lines end at \\n; a null or empty text is one empty line. A key (see line_key) of at least 10 code points that at least two
    documents hold loses all its lines but those of the smallest doc_id that holds it. Rows that share a doc_id are one document
    and give one row, with the lines of the longest; rows without doc_id go; an empty table gives an empty one; only doc_id
    and text are read. A line that very many documents hold spreads over partitions, for doc_id is part of the range key.
    """
    base = texts(docs)
    lines = mapped(base, hashed_lines, "h1 long, h2 long, doc_id long, pos int")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = durable(mapped(lines.repartitionByRange(n, "h1", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos"), first_occurrences, MARKS), "line-marks")
    # One or two keys a partition at most: the bound of what is broadcast is the number of partitions.
    firsts = marks.where(F.col("kind") != DROP).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    late = marks.where(F.col("kind") == PENDING).join(F.broadcast(firsts), ["h1", "h2"]).where("doc_id > first_doc")
    drops = marks.where(F.col("kind") == DROP).select("doc_id", "pos").unionByName(late.select("doc_id", "pos"))
    by_doc = drops.groupBy("doc_id").agg(F.collect_set("pos").alias("drops"))
    counts = base.groupBy("doc_id").agg(F.max(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("n_lines"))
    joined = counts.join(by_doc, "doc_id", "left")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            none = np.zeros(0, dtype=np.int64)
            gone = [none if d is None else np.asarray(d, dtype=np.int64) for d in b["drops"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_lines": b["n_lines"].astype(np.int64), "n_dropped": np.array([len(g) for g in gone], dtype=np.int64), "keep_bitmap": [packed(n, g) for n, g in zip(b["n_lines"], gone, strict=True)]})

    return mapped(joined, pack, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary")


def kept_text(text: str, bitmap: bytes | None, n_lines: int) -> str:
    """text without the lines whose bit is 0."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    keep = unpacked(bitmap, max(n_lines, len(lines)))
    return text if keep.all() else "\n".join([x for x, k in zip(lines, keep, strict=False) if k])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs (doc_id, text) with kept_text, n_lines, n_dropped by keep_bitmaps(); one row for each row of docs."""
    b = bitmaps.select(F.col("doc_id").alias("_of"), "n_lines", "n_dropped", "keep_bitmap").hint("shuffle_hash")
    joined = texts(docs).join(b, F.col("doc_id") == F.col("_of"), "left").drop("_of")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            kept = [kept_text(t, m if d else None, n) for t, m, n, d in zip(x["text"], x["keep_bitmap"], x["n_lines"], x["n_dropped"], strict=True)]
            yield pd.DataFrame({"doc_id": x["doc_id"], "n_lines": x["n_lines"], "n_dropped": x["n_dropped"], "kept_text": kept})

    return mapped(joined, run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def without_repeats(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with all columns and rows: text without the dropped lines, and n_chars (if there is one) counted anew. A row without doc_id stays as it is."""
    b = bitmaps.where("n_dropped > 0").select(F.struct("doc_id", "n_lines", "keep_bitmap").alias("__line_dedup")).hint("shuffle_hash")
    joined = docs.join(b, docs["doc_id"].cast("long") == F.col("__line_dedup.doc_id"), "left")
    at, last, schema = docs.columns.index("text"), len(docs.columns), docs.schema

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces:
            told = b.column(last).to_pylist()
            new = [t if t is None or m is None else kept_text(t, m["keep_bitmap"], m["n_lines"]) for t, m in zip(b.column(at).to_pylist(), told, strict=True)]
            columns = [pa.array(new, pa.string()) if i == at else b.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:last])

    new = mapped_arrow(joined, run, schema)
    return new.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else new
