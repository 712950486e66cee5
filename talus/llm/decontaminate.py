"""Benchmark decontamination: word n-grams of test items that are rare in the training documents are seeds that find passages in them; Smith-Waterman alignment scores each distinct passage once, so edited and paraphrased copies count."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, mapped, texts
from .neardup import gram_hashes

#: Words of a seed, and of those of items of at most SHORT words: with words put in between, a short copy seldom has three in a row.
SEED_WORDS, SHORT_SEED_WORDS, SHORT = 3, 2, 10
MATCH, MISMATCH, GAP = 2, 1, 1
#: Of the score of a whole copy.
THRESHOLD = 0.6
#: N-grams of items that tasks hold at a time (9 bytes each, and 8 to 16 slots of a byte in a filter); more go in groups of items, each with its own pass over the documents.
TOGETHER = 1 << 22

_MARKS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of a text; ASCII punctuation and blanks cut them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best score, end of its alignment in the passage) of the local alignment of two sequences of word numbers.

    The gaps along the passage are a running maximum, so each word of the item takes a few vector operations.
    """
    ramp = np.arange(len(passage) + 1) * GAP
    row, best, end = np.zeros(len(passage) + 1, dtype=np.int64), 0, 0
    for word in item:
        t = np.maximum(row - GAP, 0)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(passage == word, MATCH, -MISMATCH))
        row = np.maximum.accumulate(t + ramp) - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def where_possible(item: np.ndarray, passage: np.ndarray, threshold: float) -> tuple[int, int]:
    """(first word, word after the last) of what can be in an alignment of at least `threshold`; equal if none can be.

    Such an alignment has at least threshold * n matches, so at most 2 * n * (1 - threshold) edits, and lies in a window of
    n + 2 * n * (1 - threshold) words; the matches of a window are no more than its words that are in the item, each as often as there.
    """
    n, size = len(item), len(passage)
    least = math.ceil(threshold * n - 1e-9)
    if least <= 0:
        return 0, size
    of_item, of_passage = np.bincount(item, minlength=n), np.bincount(passage[passage >= 0], minlength=n)
    if np.minimum(of_item, of_passage).sum() < least:
        return 0, 0
    width = min(size, math.ceil(n + 2 * n * (1 - threshold)))
    known = np.concatenate([[0], np.cumsum(passage >= 0)])
    (alive,) = np.nonzero(known[width:] - known[: size + 1 - width] >= least)
    return (int(alive[0]), int(alive[-1]) + width) if len(alive) else (0, 0)


def smith_waterman(item: list[bytes], passage: list[bytes], threshold: float = 0.0) -> tuple[float, int, int]:
    """(score as a part of that of a whole copy, first word, word after the last) of the best alignment; 0 if none can have `threshold`."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = np.array([number[w] for w in item], dtype=np.int64)
    b = np.array([number.get(w, -1) for w in passage], dtype=np.int64)
    low, high = where_possible(a, b, threshold)
    if low == high:
        return 0.0, 0, 0
    b = b[low:high]
    best, end = align(a, b)
    back = align(a[::-1], b[:end][::-1])[1] if best else 0
    return best / (MATCH * max(1, len(item))), low + end - back, low + end


def _losses(n_words: int, threshold: float) -> Iterator[tuple[int, int]]:
    """(words exchanged or missing inside, words missing at the ends) that a copy of at least `threshold` may have at most: inside, one costs a match and a penalty, at an end a match."""
    spare = MATCH * (1 - threshold) * n_words + 1e-9
    for inside in range(min(n_words, int(spare // (MATCH + MISMATCH))) + 1):
        yield inside, int((spare - inside * (MATCH + MISMATCH)) // MATCH)


def seed_size(n_words: int, threshold: float, most: int = SEED_WORDS) -> int:
    """The words of a seed: `most`, or SHORT_SEED_WORDS for short items, or what every copy of at least `threshold` surely has in a row if that is less."""
    return max(1, min(most, SHORT_SEED_WORDS if n_words <= SHORT else most, n_words, *(math.ceil((n_words - x - ends) / (x + 1)) for x, ends in _losses(n_words, threshold))))


def least_seeds(n_words: int, threshold: float, size: int) -> int:
    """How many places of an item's n-grams every such copy has: a loss inside breaks `size` of them, one at an end breaks one."""
    return max(1, n_words - size + 1 - max(x * size + ends for x, ends in _losses(n_words, threshold)))


def reach(n_words: int, threshold: float) -> int:
    """How far before and after a seed an alignment can go: the item's words and as many gaps as the score allows."""
    return math.ceil(n_words + MATCH * n_words * (1 - threshold) / GAP)


def _item_grams(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(item_id, gram, times, size, least, reach) of the n-grams of each item, and how often it holds each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item_id, text in zip(b["doc_id"], b["text"], strict=True):
                words = words_of(text)
                n = len(words)
                own = seed_size(n, threshold, size) if n else 0
                found, times = np.unique(gram_hashes(words, own), return_counts=True)
                rows += [(item_id, g, t, own, least_seeds(n, threshold, own), reach(n, threshold)) for g, t in zip(found.view(np.int64).tolist(), times.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["item_id", "gram", "times", "size", "least", "reach"])

    return mapped(items, run, "item_id long, gram long, times int, size int, least int, reach int")


class Known:
    """Sorted n-grams, with a power of two that each one's reach is below, behind a filter of slots of their low bits."""

    def __init__(self, grams: np.ndarray, reach: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.reach = grams[order], np.frexp(reach[order].astype(np.float64))[1].astype(np.uint8)
        self.mask = np.uint64((1 << max(10, len(grams).bit_length() + 3)) - 1)
        self.slots = np.zeros(int(self.mask) + 1, dtype=bool)
        self.slots[self.grams & self.mask] = True

    def __call__(self, words: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the n-gram) of each known n-gram of a text; none but exact hits."""
        at, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for size in sizes:
            if len(words) >= size and len(self.grams):
                grams = gram_hashes(words, size)
                (hit,) = np.nonzero(self.slots[grams & self.mask])
                place = np.minimum(np.searchsorted(self.grams, grams[hit]), len(self.grams) - 1)
                exact = self.grams[place] == grams[hit]
                at.append(hit[exact])
                found.append(place[exact])
        return np.concatenate(at), np.concatenate(found)


def known(grams: DataFrame) -> Broadcast[Known]:
    """The distinct n-grams of grams (gram, reach), of which there are about TOGETHER at most, for tasks to look up."""
    rows = grams.groupBy("gram").agg(F.max("reach").alias("reach")).toArrow()
    return grams.sparkSession.sparkContext.broadcast(Known(rows["gram"].to_numpy().view(np.uint64), rows["reach"].to_numpy()))


def gram_counts(docs: DataFrame, grams: Broadcast[Known], sizes: list[int]) -> DataFrame:
    """(gram, times): how often the documents hold each known n-gram; each task sums before anything moves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = grams.value
        for b in batches:
            found, times = np.unique(np.concatenate([every(words_of(t), sizes)[1] for t in b["text"]]), return_counts=True)
            yield pd.DataFrame({"gram": every.grams[found].view(np.int64), "times": times})

    return mapped(docs, run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))


def seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """grams without the most frequent ones of each item: a copy has `least` places of them at least, so least - 1 places can be spared and it still has a seed.

    Frequency is how often the documents hold the n-gram, so what any text may say goes first.
    """
    order = W.partitionBy("item_id").orderBy(F.desc("df"), "gram")
    df = counts.select("gram", F.col("times").alias("df"))
    return grams.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("spared", F.sum("times").over(order)).where("spared >= least").select("item_id", "gram", "size", "reach")


def _passages(docs: DataFrame, grams: Broadcast[Known], sizes: list[int]) -> DataFrame:
    """(doc_id, key, start, words, grams): what lies within reach of the seeds; equal passages have one key.

    Each seed reaches as far as its own items need, so an item of any length widens only what its own seeds find.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = grams.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                words = words_of(text)
                at, found = every(words, sizes)
                if not len(at):
                    continue
                far = np.int64(1) << every.reach[found].astype(np.int64)
                low, high = np.maximum(at - far, 0), np.minimum(at + far + max(sizes), len(words))
                order = np.lexsort((at, low))
                low, high, found = low[order], np.maximum.accumulate(high[order]), every.grams[found[order]].view(np.int64)
                for own in np.split(np.arange(len(low)), np.nonzero(low[1:] > high[:-1])[0] + 1):
                    start, end = int(low[own[0]]), int(high[own[-1]])
                    passage, held = b" ".join(words[start:end]), np.unique(found[own])
                    key = hashlib.blake2b(passage + b"\0" + held.tobytes(), digest_size=16).digest()
                    rows.append((doc_id, key, start, passage, held))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "start", "words", "grams"])

    return mapped(docs, run, "doc_id long, key binary, start long, words binary, grams array<long>")


def find_leaks(docs: DataFrame, items: DataFrame, size: int = SEED_WORDS, threshold: float = THRESHOLD, together: int = TOGETHER) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of documents that hold a copy of an item, exact, edited or in part.

    docs (doc_id, text) and items (item_id, text) are taken whole. score is the Smith-Waterman score of words (+2, -1, gap -1)
    as a part of that of a whole copy; pairs of at least `threshold` come back, once each with their best passage (on ties the
    first). No pair is lost whose copy exchanges words or leaves them out, for such a copy has a seed (see seed_size() and
    seeds()); with words put in between, it has one unless they break every run of the seed's words that is not spared.
    The documents are read twice, to count the items' n-grams and to find the seeds, for each `together` n-grams of items.

    Texts and items of any length are taken whole; items of fewer words than `size` are sought by fewer; items without words, and
    null texts, match nothing; rows without an id go; repeated rows and ids give one row; empty tables give an empty one; other
    columns are not read.
    """
    tests, base = texts(items, "item_id").distinct(), texts(docs)
    grams = durable(_item_grams(tests, size, threshold), "item-grams")
    groups = -(-grams.count() // together)
    if groups <= 1:
        return _leaks(base, tests, grams, threshold)
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    parts = [_leaks(base, tests.where(group("doc_id") == g), grams.where(group("item_id") == g), threshold) for g in range(groups)]
    return functools.reduce(DataFrame.unionByName, parts)


def _leaks(docs: DataFrame, tests: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # SEED_WORDS values at most
    counts = durable(gram_counts(docs, known(grams), sizes), "gram-counts")
    rare = durable(seeds(grams, counts), "seeds")
    found = durable(_passages(docs, known(rare), sizes), "passages")
    # Each distinct passage meets each item that it shares a seed with, however frequent, and is aligned once.
    passages = found.groupBy("key").agg(F.first("words").alias("words"), F.first("grams").alias("grams"))
    hits = passages.select("key", F.explode("grams").alias("gram"))
    pairs = passages.drop("grams").join(hits.join(rare.select("gram", "item_id"), "gram").select("key", "item_id").distinct(), "key")
    both = pairs.join(tests.select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text")), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, item_id, words, item in zip(b["key"], b["item_id"], b["words"], b["item_text"], strict=True):
                score, first, end = smith_waterman(words_of(item), words.split(), threshold)
                if score >= threshold:
                    rows.append((key, item_id, score, first, end))
            yield pd.DataFrame(rows, columns=["key", "item_id", "score", "first_word", "end_word"])

    aligned = mapped(both.select("key", "item_id", "words", "item_text"), run, "key binary, item_id long, score double, first_word long, end_word long")
    places = found.select("doc_id", "key", "start").join(durable(aligned, "aligned"), "key")
    scored = places.select("doc_id", "item_id", "score", (F.col("start") + F.col("first_word")).alias("first_word"), (F.col("start") + F.col("end_word")).alias("end_word"))
    best = scored.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"), -F.col("end_word"))).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.first_word", "b.end_word")
