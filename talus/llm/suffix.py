"""Suffix-array dedup: bytes covered by long strings that start more than once, from common-prefix intervals of enhanced suffix arrays.

Every window of WINDOW bytes has an anchor, the k-gram of least hash in it, which equal windows have at the same place. The
suffixes at anchors, dealt by their first k bytes, are a sparse suffix array in pieces: in each, suffixes are sorted, a stack scan
of their common prefixes gives the tree of intervals, and a test of how far the members extend to the left, and where they differ
there, turns each interval into maximal repeat groups with all of their occurrences. What is covered follows from these groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mapped, texts
from .neardup import _mix

WINDOW, GRAM = 400, 64
#: Windows that are looked at together in a long text.
SEGMENT = 1 << 20
#: Different contexts that are sorted together; a larger set is dealt anew by more of its bytes until each part is no larger.
TOGETHER, FAN = 512, 4

_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9FB21C651E98DF25
_PLACE = np.uint64((1 << 24) - 1)

ANCHORS = "fp long, c1 long, c2 long, doc_id long, at long, left int, right int"


def gram_hash(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM-byte strings at each place, by doubling."""
    h, step = _BYTES[data], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        step *= 2
    return _mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: minima from both ends of blocks of w."""
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor: the windows that start in between have it as theirs."""
    out = []
    for s in range(0, max(0, len(data) - WINDOW + 1), SEGMENT):
        h = gram_hash(data[s : s + SEGMENT + WINDOW - 1])
        place = (sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), WINDOW - GRAM + 1) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
        last = np.concatenate([first[1:], [len(place)]]) - 1
        out.append((h[place[first]], place[first] + s, first + s, last + s))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _context_key(context: bytes, left: int) -> tuple[int, int]:
    """128 bits of a context and the anchor's place in it."""
    c1, c2 = np.frombuffer(hashlib.blake2b(context, digest_size=16).digest(), dtype="<i8").tolist()
    return c1 ^ left, c2


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts, keys = [], []
        for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            fp, at, first, last = anchors(np.frombuffer(raw, dtype=np.uint8))
            left, right = at - first, last + WINDOW - at
            keys += [hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)]
            parts.append((fp.view(np.int64), np.full(len(at), doc_id, dtype=np.int64), at, left.astype(np.int32), right.astype(np.int32)))
        fp, doc, at, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
        c = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
        # The anchor's place in its context belongs to the key.
        yield pd.DataFrame({"fp": fp, "c1": c[:, 0] ^ left, "c2": c[:, 1], "doc_id": doc, "at": at, "left": left, "right": right})


def _adjacent(strings: list[bytes]) -> np.ndarray:
    """Common prefixes of neighbours in a sorted list."""
    size = np.array([len(s) for s in strings])
    width = int(size.max(initial=0))
    m = np.zeros((len(strings), width + 1), dtype=np.uint8)
    for row, s in zip(m, strings, strict=True):
        row[: len(s)] = np.frombuffer(s, dtype=np.uint8)
    differ = m[1:] != m[:-1]
    differ[:, width] = True
    return np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))


class _RangeMin:
    """Least values of ranges of an array, from minima over powers of two."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while len(self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp(end - begin)[1] - 1
        out = np.empty(len(begin), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][begin[at]], self.levels[k][end[at] - (1 << k)])
        return out


def lcp_intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of a sorted list, children before parents, by a stack scan."""
    stack = [(0, 0)]
    for i, x in enumerate([*lcp.tolist(), 0], start=1):
        begin = i - 1
        while stack[-1][0] > x:
            length, begin = stack.pop()
            yield length, begin, i - 1
        if stack[-1][0] < x:
            stack.append((x, begin))


Group = tuple[int, int, np.ndarray, np.ndarray]


def maximal_groups(contexts: list[bytes], lefts: list[int], copies: list[int], window: int = WINDOW, inner: bool = False) -> Iterator[Group]:
    """(bytes before the anchor, bytes from it on, members, bytes before it that each has in common with some other) of the maximal repeat groups of `window` bytes or more.

    contexts are different strings around one anchor, with lefts[i] bytes before it, each occurring copies[i] times. Those that
    occur again are groups by themselves: equal suffixes, up to the context's ends. An interval of the suffix array gives its
    members a common right side; sorted by what stands to the left, backwards, they fall into runs that have enough in common
    there. A run ends where the left extensions differ, and is a group of its own unless one child of the interval holds it
    whole, which then has a longer right side in common. `inner` gives also the groups inside a run, of those members that have
    more on the left in common than the run; the last value tells as much for each member.
    """
    n = len(contexts)
    rights = [c[x:] for c, x in zip(contexts, lefts, strict=True)]
    for i in range(n):
        if copies[i] > 1:
            yield lefts[i], len(rights[i]), np.array([i]), np.array([lefts[i]])
    if n < 2:
        return
    backs = [c[:x][::-1] for c, x in zip(contexts, lefts, strict=True)]
    suffixes = np.array(sorted(range(n), key=rights.__getitem__))
    by_left = np.array(sorted(range(n), key=backs.__getitem__))
    rank = np.empty(n, dtype=np.int64)
    rank[by_left] = np.arange(n)
    common = _RangeMin(_adjacent([backs[i] for i in by_left]).astype(np.int64))
    child, most_left = -1 - np.arange(n), max(lefts)
    for k, (length, first, last) in enumerate(lcp_intervals(_adjacent([rights[i] for i in suffixes]))):
        members = suffixes[first : last + 1]
        if length + most_left >= window:
            own = np.sort(rank[members])
            left = common(own[:-1], own[1:])
            near = np.concatenate([[-window], left, [-window]])
            enough = near + length >= window
            starts, ends = np.nonzero(enough[1:] & ~enough[:-1])[0], np.nonzero(enough[:-1] & ~enough[1:])[0] + 1
            for begin, end in zip(starts.tolist(), ends.tolist(), strict=True):
                run = by_left[own[begin:end]]
                if (child[run] == child[run[0]]).all():
                    continue
                least, own_left = int(near[begin + 1 : end].min()), np.maximum(near[begin:end], near[begin + 1 : end + 1])
                yield least, length, run, own_left
                for more, a, z in lcp_intervals(near[begin + 1 : end]) if inner else ():
                    part = run[a : z + 1]
                    if more > least and (child[part] != child[part[0]]).any():
                        yield more, length, part, own_left[a : z + 1]
        child[members] = k


def extents(groups: Iterator[Group], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before the anchor, bytes from it on) that the groups of n contexts cover; 0, 0: none."""
    before, after = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for _, length, members, left in groups:
        before[members] = np.maximum(before[members], left)
        after[members] = np.maximum(after[members], length)
    return before, after


#: A class of equal contexts: its key, how often it occurs, its bytes, and the node (low, high, k1, k2) of the deal that it is in.
NODES = "low int, high int, k1 long, k2 long, fp long, c1 long, c2 long, n long, left int, context binary"
_NODE_COLUMNS = [x.split()[0] for x in NODES.split(", ")]


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of nodes in the FAN parts of the node.

    A node is of windows that start `low` to `high` bytes before the anchor; its members have equal bytes from `low` before the
    anchor to the end of the window that starts `high` before it, which are its key. Two contexts that share a window of the node
    share the key of the part that the window is in.
    """
    for b in batches:
        rows = []
        for low, high, _, _, fp, c1, c2, n, left, context in b[_NODE_COLUMNS].itertuples(index=False, name=None):
            step = -(-(high - low + 1) // FAN)
            for x in range(low, high + 1, step):
                y = min(x + step - 1, high)
                if left >= x and len(context) - left >= WINDOW - y:
                    k1, k2 = np.frombuffer(hashlib.blake2b(context[left - x : left + WINDOW - y], digest_size=16, key=b"%d-%d" % (fp, x)).digest(), dtype="<i8")
                    rows.append((x, y, k1, k2, fp, c1, c2, n, left, context))
        yield pd.DataFrame(rows, columns=_NODE_COLUMNS)


def _by_node(use, columns: list[str]):
    """A function over rows in order of their node (k1, k2): use(rows) for each node at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[tuple] = []
        for b in batches:
            out = []
            for r in b[_NODE_COLUMNS].itertuples(index=False, name=None):
                if own and own[0][2:4] != r[2:4]:
                    out += use(own)
                    own = []
                own.append(r)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(use(own) if own else [], columns=columns)

    return run


def _groups_of(rows: list[tuple], inner: bool = False) -> Iterator[Group]:
    return maximal_groups([r[9] for r in rows], [r[8] for r in rows], [r[7] for r in rows], inner=inner)


def _covered(rows: list[tuple]) -> list[tuple]:
    before, after = extents(_groups_of(rows), len(rows))
    return [(*r[4:7], x, y) for r, x, y in zip(rows, before.tolist(), after.tolist(), strict=True) if y]


def _covered_leaf(shared: DataFrame) -> DataFrame:
    again = F.col("n") > 1
    before, after = F.when(again, F.col("left")).otherwise(F.col("low")), F.when(again, F.length("context") - F.col("left")).otherwise(WINDOW - F.col("low"))
    return shared.select("fp", "c1", "c2", before.alias("before"), after.alias("after"))


def _listed(rows: list[tuple]) -> list[tuple]:
    """One row for each member of a group; equal contexts are a group that their class names."""
    out = []
    for i, (common, length, members, _) in enumerate(_groups_of(rows, inner=True)):
        out += [(*(rows[m][2:4] if len(members) > 1 else rows[m][5:7]), i if len(members) > 1 else -1, *rows[m][4:7], common, length) for m in members.tolist()]
    return out


def _listed_leaf(shared: DataFrame) -> DataFrame:
    window = shared.where("members > 1").select("k1", "k2", F.lit(0).alias("group"), "fp", "c1", "c2", F.col("low").alias("before"), (WINDOW - F.col("low")).alias("after"))
    again = shared.where("n > 1").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.lit(-1).alias("group"), "fp", "c1", "c2", F.col("left").alias("before"), (F.length("context") - F.col("left")).alias("after"))
    return window.unionByName(again)


def occurrences(base: DataFrame) -> DataFrame:
    """The anchors (see ANCHORS) of base (doc_id, text) whose k-gram is that of another anchor too."""
    found = durable(mapped(base, _anchor_rows, ANCHORS), "anchors")
    # Written first: then both sides of the join are plain exchanges, whose large partitions Spark splits.
    often = durable(found.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"), "repeated-anchors")
    return durable(found.join(often, "fp", "left_semi"), "occurrences")


def context_classes(base: DataFrame, occurring: DataFrame) -> DataFrame:
    """NODES rows at the root: each different context of an anchor once, with its bytes and how often it occurs."""
    classes = durable(occurring.groupBy("fp", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at", "left", "right")).alias("one")).select("fp", "c1", "c2", "n", "one.*"), "classes")
    wanted = classes.select("doc_id", F.struct("at", "left", "right", "fp", "c1", "c2", "n").alias("w")).groupBy(F.col("doc_id").alias("_of")).agg(F.collect_list("w").alias("wanted"))
    joined = base.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("_of")).select("text", "wanted")

    def bytes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, wanted in zip(b["text"], b["wanted"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    begin, end = w["at"] - w["left"], w["at"] + w["right"]
                    if end <= len(raw) and _context_key(raw[begin:end], w["left"]) == (w["c1"], w["c2"]):
                        rows.append((0, WINDOW - GRAM, w["fp"], 0, w["fp"], w["c1"], w["c2"], w["n"], w["left"], raw[begin:end]))
            yield pd.DataFrame(rows, columns=_NODE_COLUMNS)

    # Rows that share a doc_id may give a context twice; it occurs twice then, so that changes nothing.
    return durable(mapped(joined, bytes_of, NODES, 500_000), "contexts")


def _scanned(contexts: DataFrame, use: Callable[[list[tuple]], list[tuple]], leaf: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What use(rows) gives for each node: the root nodes of up to TOGETHER members, and those that larger ones are dealt into, by ever more of their bytes.

    The members of a leaf (one window) have that window in common: leaf(rows, with the number of `members`) needs no sorting, so
    however many they are, they are never gathered.
    """
    n, now, out = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), contexts, None
    scan = _by_node(use, [x.split()[0] for x in schema.split(", ")])
    while True:
        large = durable(now.groupBy("k1", "k2").agg(F.count("*").alias("members")).where(F.col("members") > TOGETHER), "large-nodes")
        small = now.join(large.select("k1", "k2"), ["k1", "k2"], "left_anti")
        found = mapped(small.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2"), scan, schema)
        out = found if out is None else out.unionByName(found)
        if large.isEmpty():
            return out
        both = now.join(large, ["k1", "k2"])
        out = out.unionByName(leaf(both.where("low = high")))
        dealt = durable(mapped(both.where("low < high").drop("members"), _children, NODES), "nodes")
        # What is alone in its part shares no window of it.
        alive = durable(dealt.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where("n > 1").select("k1", "k2"), "live-nodes")
        now = dealt.join(alive, ["k1", "k2"], "left_semi")


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(k1, k2, group, length, doc_id, first) of the maximal repeat groups of WINDOW bytes or more around each anchor: one row for each occurrence.

    (k1, k2, group) names a group; its strings are the `length` bytes from `first` on in each doc_id. Strings longer than an anchor's
    context appear in pieces, one for each anchor; of a set that is too large to be sorted together, a group appears for each part
    of the deal that it is in, at least with the windows of that part. Nulls, empty and long texts: as in remove_repeats().
    """
    base = texts(docs)
    occurring = occurrences(base)
    members = durable(_scanned(context_classes(base, occurring), _listed, _listed_leaf, "k1 long, k2 long, group int, fp long, c1 long, c2 long, before int, after int").distinct(), "group-members")
    joined = occurring.join(members, ["fp", "c1", "c2"])
    return joined.select("k1", "k2", "group", (F.col("before") + F.col("after")).alias("length"), "doc_id", (F.col("at") - F.col("before")).alias("first"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last): byte ranges [first, last) of documents that the occurrences of maximal repeat groups cover."""
    base = texts(docs)
    occurring = occurrences(base)
    covered = _scanned(context_classes(base, occurring), _covered, _covered_leaf, "fp long, c1 long, c2 long, before int, after int")
    # One row for each class, whichever nodes it was in.
    classes = durable(covered.groupBy("fp", "c1", "c2").agg(F.max("before").alias("before"), F.max("after").alias("after")), "covered-classes")
    return occurring.join(classes, ["fp", "c1", "c2"]).select("doc_id", (F.col("at") - F.col("before")).alias("first"), (F.col("at") + F.col("after")).alias("last"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans) of every row of docs: its UTF-8 bytes without those that repeats cover; spans are the removed ranges [first, last).

    A byte goes if a string of WINDOW bytes over it also starts anywhere else, in the same document or another, overlaps included;
    strings are judged on the input. A null text is an empty one; texts shorter than WINDOW stay; a text of any length is taken
    whole; rows without doc_id go; a row that is repeated repeats its text, and rows that share a doc_id share their spans; an
    empty table gives an empty one; only doc_id and text are read.
    """
    spans = repeated_spans(docs).groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set(F.struct("first", "last")).alias("found"))
    joined = texts(docs).join(spans.hint("shuffle_hash"), F.col("doc_id") == F.col("_of"), "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, found in zip(b["doc_id"], b["text"], b["found"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone = merged([(s["first"], min(s["last"], len(raw))) for s in found] if found is not None else [])
                kept, done = [], 0
                for first, last in gone:
                    kept.append(raw[done:first])
                    done = last
                rows.append((doc_id, len(raw), sum(e - s for s, e in gone), len(gone), b"".join([*kept, raw[done:]]), [{"first": s, "last": e} for s, e in gone]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return mapped(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<first:long,last:long>>")
