"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata, scored in linear time by the sum-of-squares identity."""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mapped_arrow, texts

#: Hash buckets of words, bins of each statistic, rank of the pairwise interactions.
BUCKETS, BINS, RANK = 4096, 8, 8
#: Labelled rows that the model is fitted on at most: those of smallest hash, so that any input gives a fixed choice.
SAMPLE = 6000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.08, 1e-4, 17
CUT = 0.3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~", b"|<>{}[]\\=_", b"!?", b".,;:", b"\n", b" \t", bytes(range(128, 256))]
_MASK = np.zeros((256, len(_CLASSES)))
for _i, _chars in enumerate(_CLASSES):
    _MASK[list(_chars), _i] = 1
STATS = len(_CLASSES) + 7


def statistics(text: str, counts: Counter, n_words: int) -> np.ndarray:
    """Structure of a text (shares of character classes, repetition of words and lines, word length) and its length."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    share = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _MASK / n
    lines = text.split("\n")
    top = max(counts.values(), default=0)
    more = [np.log1p(len(data)), np.log1p(n_words), n / max(1, n_words), len(counts) / max(1, n_words), top / max(1, n_words), len(set(lines)) / len(lines), sum(counts[w] for w in counts if len(w) > 3 and not w[-1].isalnum() and not w[-2].isalnum()) / max(1, n_words)]
    return np.concatenate([share, more])


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, statistics): hashed words with damped counts of length 1 in all, and the statistics."""
    words = text.lower().split()
    counts = Counter(words)
    sums = np.bincount(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in counts), dtype=np.int64, count=len(counts)), weights=np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts))), minlength=BUCKETS)
    (at,) = np.nonzero(sums)
    value = sums[at]
    return at, value / max(1e-9, np.sqrt((value**2).sum())), statistics(text, counts, len(words))


def with_bins(at: np.ndarray, value: np.ndarray, stats: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse row of a text: hashed words, then one active bin for each statistic."""
    bins = (stats[:, None] > edges).sum(axis=1)
    return np.concatenate([at, BUCKETS + np.arange(STATS) * BINS + bins]), np.concatenate([value, np.full(STATS, 1 / np.sqrt(STATS))])


def raw_score(model: dict, index: np.ndarray, value: np.ndarray) -> float:
    """w0 + sum w x + half of sum over factors of (sum v x)^2 - sum (v x)^2."""
    vx = model["v"][index] * value[:, None]
    return float(model["w0"] + model["w"][index] @ value + 0.5 * (vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> dict:
    """A factorisation machine by AdaGrad on the logistic loss. No rows, or one class only: a constant score."""
    stats = np.array([r[2] for r in rows]).reshape(-1, STATS)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(rows) else np.zeros((STATS, BINS - 1))
    dim, rng = BUCKETS + STATS * BINS, np.random.default_rng(SEED)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    model = {"edges": edges, "w0": float(np.log(rate / (1 - rate))), "w": np.zeros(dim), "v": rng.normal(0, 0.05, (dim, RANK))}
    if len(rows) == 0 or labels.min() == labels.max():
        model["v"][:] = 0
        return model
    sparse = [with_bins(*r, edges) for r in rows]
    gw, gv, g0 = np.full(dim, 1e-3), np.full((dim, RANK), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            index = np.concatenate([sparse[i][0] for i in part])
            value = np.concatenate([sparse[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(sparse[i][0]) for i in part])
            begin = np.concatenate([[0], np.cumsum([len(sparse[i][0]) for i in part])[:-1]])
            vx = model["v"][index] * value[:, None]
            total = np.add.reduceat(vx, begin, axis=0)
            score = model["w0"] + np.add.reduceat(model["w"][index] * value, begin) + 0.5 * (total**2 - np.add.reduceat(vx**2, begin, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[part])[row]
            unique, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, weights=error * value) + DECAY * model["w"][unique]
            dv_all = (error * value)[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(where, weights=dv_all[:, f]) for f in range(RANK)], axis=1) + DECAY * model["v"][unique]
            gw[unique] += dw**2
            gv[unique] += dv**2
            model["w"][unique] -= RATE * dw / np.sqrt(gw[unique])
            model["v"][unique] -= RATE * dv / np.sqrt(gv[unique])
            d0 = error[begin].sum()
            g0 += d0**2
            model["w0"] -= RATE * d0 / np.sqrt(g0)
    return model


def held_out(column: str = "doc_id"):
    """crc32(doc_id as text) mod 5 = 0: rows whose labels are never learnt from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of labels.quality, fitted in one task on SAMPLE rows at most that are not held out."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("_of"), F.col("quality").cast("int").alias("quality")).where("_of IS NOT NULL AND quality IN (0, 1)").where(~held_out("_of")).orderBy(F.xxhash64("_of"), "_of", "quality").limit(SAMPLE)
    # SAMPLE bounds what is broadcast and what the one task reads.
    sample = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_of")).select("doc_id", "text", "quality")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "features": [pickle.dumps(features(t)) for t in b["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"doc_id": [], "quality": [], "features": []})], ignore_index=True).drop_duplicates().sort_values(["doc_id", "quality", "features"])
        yield pd.DataFrame({"model": [pickle.dumps(fit([pickle.loads(f) for f in rows["features"]], rows["quality"].to_numpy(dtype=np.float64)))]})

    found = mapped(mapped(sample, featurise, "doc_id long, quality int, features binary").repartition(1), learn, "model binary").collect()
    return pickle.loads(found[0]["model"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, over its whole text.

    score is the probability of label 1; predicted is 1 from CUT on. A null or empty text is scored by its statistics; rows
    without doc_id go; repeated rows each have a result; an empty table gives an empty one. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            raw = np.array([raw_score(m, *with_bins(*features(t), m["edges"])) for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(raw, -30, 30)))})

    return mapped(texts(docs), run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, with all columns, whose text scores CUT or more; the score is taken where the row is, without a shuffle. A null text is scored as an empty one."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces:
            raw = np.array([raw_score(m, *with_bins(*features(t or ""), m["edges"])) for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))) >= CUT))

    return mapped_arrow(docs, run, docs.schema)
