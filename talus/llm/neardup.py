"""MinHash near-dedup with sequential Bayesian verification: signature batches of banded candidates are compared, pairs whose posterior falls below a miss probability are pruned, and the others are verified exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, durable, mapped, texts
from .graph import components

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Hashes compared before each look at the posterior; the probability of missing a pair that a look accepts.
BATCH, MISS = 25, 1e-6
#: Members of a contested bucket that are compared with each other in one block.
BLOCK = 1000

_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, kept for the frequent ones (the first KEPT met)."""

    KEPT = 300_000

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < self.KEPT:
            self[word] = h
        return h


_words = WordHashes()
CACHES.append(_words)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of the runs of `size` words at each place; fewer words are one run, none give none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    x = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        x = (x + h[i : len(h) - size + 1 + i]) * _P
        x ^= x >> np.uint64(29)
    return _mix(x)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text: A-Z lower-cased, words cut at ASCII blanks.

    Fewer words than `size` are one shingle; no words are the empty set.
    """
    return np.unique(gram_hashes(text.encode("utf-8", "surrogatepass").lower().split(), size))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits."""
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(shingles), 4096):
        x = (shingles[None, start : start + 4096] * _MUL[:, None] + _ADD[:, None]) >> np.uint64(32)
        np.minimum(out, x.min(axis=1).astype(np.uint32), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, its number mixed in."""
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).astype(np.uint64).T:
        x = _mix(x * _P + column)
    return x.view(np.int64)


def least_matches(threshold: float) -> list[int]:
    """After each batch, the fewest equal hashes at which P(similarity >= threshold) is still MISS.

    With a uniform prior the posterior of m matches in n is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < MISS:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of signatures a and b stay after all batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for i, least in enumerate(least_matches(threshold)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig, bands): set size, 128-bit key of the set, signature of 16 bits a hash, and band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                s = shingle_set(text, size)
                k = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                sig = signature(s)
                rows.append((doc_id, len(s), k[0], k[1], sig.astype(np.uint16).tobytes(), band_keys(sig) if len(s) else []))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"])

    return mapped(texts(docs), run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>")


def _sigs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype=np.uint16).reshape(-1, HASHES)


def likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the Bayesian comparison of their signatures does not prune."""
    sig = reps.select("rep", "sig")
    with_b = pairs.join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    both = with_b.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield x.loc[surviving(_sigs(x["sig_a"]), _sigs(x["sig_b"]), threshold), ["a", "b"]]

    return mapped(both, run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    The text of b travels with its pair; that of a, which many pairs may share, only meets them in the join.
    """
    ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "verify-ids")
    needed = texts(docs).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    with_b = pairs.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, np.zeros(0, dtype=np.uint64)
        for x in batches:
            good = []
            for a, ta, tb in zip(x["a"], x["text_a"], x["text_b"], strict=True):
                if a != last:
                    last, left = a, shingle_set(ta, size)
                right = shingle_set(tb, size)
                common = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * common >= percent * (len(left) + len(right) - common))
            yield x.loc[np.array(good, dtype=bool), ["a", "b"]]

    return mapped(both, run, "a long, b long")


def _dealt(members: DataFrame) -> DataFrame:
    """members (key, n, rep, ...) for each two blocks (i, j) of their key's about BLOCK members, `own` being that of the row: no key is gathered whole."""
    blocks = members.withColumn("of", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int"))
    paired = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return paired.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "of", "other")


class _Forest:
    """Labels of joined members; join() tells which of the others were not yet joined with r, one for each label."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]

    def join(self, r: int, others: np.ndarray) -> np.ndarray:
        labels, first = np.unique(self.label[others], return_index=True)
        new = labels != self.label[r]
        if new.any():
            self.label[np.isin(self.label, labels)] = self.label[r]
        return others[first[new]]


def _cross(x: pd.DataFrame, threshold: float, exact=None) -> pd.DataFrame:
    """Of two blocks: links (a, b) that join all that the pairs of different components which survive (and meet `exact`) join, no more than members."""
    sigs, rep, own = _sigs(x["sig"]), x["rep"].to_numpy(), x["own"].to_numpy()
    comp, i, j = x["comp"].to_numpy(), int(x["i"].iloc[0]), int(x["j"].iloc[0])
    forest, out = _Forest(rep if exact is None else comp), []
    left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
    for r in left:
        others = right[(comp[right] != comp[r]) & (forest.label[right] != forest.label[r]) & ((rep[right] > rep[r]) if i == j else True)]
        if len(others):
            others = others[surviving(np.broadcast_to(sigs[r], (len(others), HASHES)), sigs[others], threshold)]
        if len(others) and exact is not None:
            others = others[exact(r, others)]
        if len(others):
            new = forest.join(r, others)
            out.append(np.stack([np.minimum(rep[new], rep[r]), np.maximum(rep[new], rep[r])], axis=1))
    found = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def _families(contested: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a forest over the members of contested buckets that signatures leave as possible links of different components."""
    return _dealt(contested).groupBy("key", "i", "j").applyInPandas(lambda x: _cross(x, threshold), "a long, b long").distinct()


def _links_in_families(members: DataFrame, threshold: float, percent: int) -> DataFrame:
    """(a, b): exact links, as a forest, of members (key, n, rep, comp, sig, shingles) of a family."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(bytes(s), dtype=np.uint64) for s in x["shingles"]]
        size = np.array([len(s) for s in sets])
        begin = np.cumsum(size) - size
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(names), dtype=np.int64)

        def exact(r: int, others: np.ndarray) -> np.ndarray:
            own = at[begin[r] : begin[r] + size[r]]
            mark[own] = 1
            common = np.array([mark[at[begin[o] : begin[o] + size[o]]].sum() for o in others])
            mark[own] = 0
            return 100 * common >= percent * (size[r] + size[others] - common)

        return _cross(x, threshold, exact)

    return _dealt(members).groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(rep, shingles) of the documents in ids (rep)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rep": b["doc_id"], "shingles": [shingle_set(t, size).tobytes() for t in b["text"]]})

    wanted = texts(docs).join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return mapped(wanted, run, "rep long, shingles binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Documents whose sets of `size`-word shingles have 100 * intersection >= percent * union are linked; component_id is the
    smallest doc_id that links reach. Documents without words, or null, are linked with nothing; a repeated row gets the same
    result again; rows without doc_id go; an empty table gives an empty one; only doc_id and text are read.

    Equal sets are one class from the start. In each band bucket every class is compared with the smallest; buckets whose
    members are then still in different components have those compared in blocks by signature; what may still be linked forms
    families, whose full sets are compared in blocks. So no pair that shares a bucket is passed over, and what is emitted are
    forests, never all pairs.
    """
    threshold = percent / 100
    signed = durable(signatures(docs, size), "signatures")
    linked = signed.where("n_shingles > 0")
    classes = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    first = linked.groupBy("k1", "k2").agg(F.min_by("sig", "doc_id").alias("sig"), F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"))
    reps = durable(first.select("rep", "sig", "bands"), "classes")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = durable(banded.join(buckets, "key").select("key", "rep", "a", "n"), "buckets")
    stars = shared.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    links = durable(verified(durable(likely(stars, reps, threshold), "likely"), docs, size, percent), "links")
    comps = components(links)
    # Two members: the pair has been compared already.
    placed = shared.where("n > 2").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    contested = durable(placed.join(open_keys, "key", "left_semi").join(reps.select("rep", "sig"), "rep"), "contested")
    if not contested.isEmpty():
        maybe = durable(_families(contested, threshold), "maybe")
        if not maybe.isEmpty():
            tree = components(maybe)
            family = durable(tree.select(F.col("component").alias("key"), F.col("node").alias("rep")).unionByName(tree.select(F.col("component").alias("key"), F.col("component").alias("rep"))).distinct(), "families")
            sized = family.join(family.groupBy("key").agg(F.count("*").alias("n")), "key")
            sets = shingle_sets(docs, family.select("rep"), size)
            own = comps.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
            members = sized.join(own, "rep", "left").join(reps.select("rep", "sig"), "rep").join(sets, "rep").withColumn("comp", F.coalesce("comp", "rep"))
            extra = durable(_links_in_families(members, threshold, percent), "links")
            if not extra.isEmpty():
                comps = components(links.unionByName(extra))
    ids = signed.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return ids.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
