"""What two incidents have in common, for all pairs of two blocks of rows at once: Spark deals blocks of a bounded size to tasks, numpy compares them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..sources.files import settled

#: Rows that are compared at a time, how many times as many a block may have, and words whose columns of a matrix are held at a time.
BLOCK, WIDER, WORDS = 1024, 8, 2048
#: Words that so many pairs share are columns of a matrix, the pairs of others are counted one by one, so many at a time.
OFTEN, PAIRS_AT_ONCE = 2048, 1 << 22
#: Tiles of a partition, at least, before blocks become wider.
TILES = 3
DAY = 86_400_000
#: The parts of the score are told in hundredths, which a division by 100 gives back as they are written.
PARTS = ("s_casualty", "s_title", "s_alike", "s_words", "s_source", "s_date")
#: What two rows' kinds add, as it is.
BY_KIND = ("s_location", "s_group")
#: The most that like titles add, and pairs of titles whose edits are counted at a time.
MOST_ALIKE, AT_ONCE = 25, 16_384
#: Fewer pairs than a part of so many have their edits counted without a look at what characters they share.
FEW = 64
TILE = ["f_state", "_low", "_i", "_high", "_j"]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the ranges."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


#: Different values in order, where each one's rows begin, how many, and the rows.
Held = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _held(rows: np.ndarray, codes: np.ndarray) -> Held:
    """The lists (row, code) by their codes."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], starts, np.diff(np.concatenate([starts, [len(codes)]])), rows[order]


def _met(a: Held, b: Held, shape: tuple[int, int], place: np.ndarray) -> np.ndarray:
    """How many values each row of a shares with each row of b. `place` has -1 for each code, and is left so."""
    out = np.zeros(shape, np.float32)
    place[b[0]] = np.arange(len(b[0]))
    j = place[a[0]]
    place[b[0]] = -1
    i = np.flatnonzero(j >= 0)
    j = j[i]
    sides = [(a[1][i], a[2][i], a[3]), (b[1][j], b[2][j], b[3])]
    n = sides[0][1] * sides[1][1]
    often = np.flatnonzero(n > OFTEN)
    for start in range(0, len(often), WORDS):
        own, dense = often[start : start + WORDS], []
        for (starts, counts, rows), size in zip(sides, shape, strict=True):
            m = np.zeros((size, len(own)), np.float32)
            m[rows[_ranges(starts[own], counts[own])], np.repeat(np.arange(len(own)), counts[own])] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    rare = np.flatnonzero(n <= OFTEN)
    ends = np.cumsum(n[rare])
    cuts = np.searchsorted(ends, np.arange(PAIRS_AT_ONCE, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE))
    for own in np.split(rare, cuts):
        if not len(own):
            continue
        (start_a, n_a, rows_a), (start_b, n_b, rows_b) = sides
        first, each = rows_a[_ranges(start_a[own], n_a[own])], np.repeat(n_b[own], n_a[own])
        second = rows_b[_ranges(np.repeat(start_b[own], n_a[own]), each)]
        out += np.bincount(np.repeat(first, each) * shape[1] + second, minlength=shape[0] * shape[1]).reshape(shape).astype(np.float32)
    return out


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many values each row of a shares with each row of b, of lists (row, value) without repeats in a row."""
    known, codes = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
    codes = codes.reshape(-1)
    return _met(_held(a[0], codes[: len(a[1])]), _held(b[0], codes[len(a[1]) :]), shape, np.full(len(known), -1, np.int64))


class _Lists:
    """Lists (row, value) of two sides, or one: how many values rows of a part of one share with rows of a part of the other."""

    def __init__(self, sides: list[tuple[np.ndarray, np.ndarray]], sizes: list[int]):
        known, codes, n = np.unique(np.concatenate([v for _, v in sides]), return_inverse=True, return_counts=True)
        codes, at, self.parts = codes.reshape(-1), 0, []
        for (rows, values), size in zip(sides, sizes, strict=True):
            own = codes[at : at + len(values)]
            at += len(values)
            # What one row alone has is in no overlap.
            kept = n[own] > 1
            rows, own = rows[kept], own[kept]
            ends = np.searchsorted(rows, np.arange(0, size + BLOCK, BLOCK))
            self.parts.append([_held(rows[x:y] - k * BLOCK, own[x:y]) for k, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True))])
        self.place = np.full(len(known), -1, np.int64)

    def met(self, i: int, j: int, shape: tuple[int, int]) -> np.ndarray:
        return _met(self.parts[0][i], self.parts[-1][j], shape, self.place)


def _overlap(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return common.astype(np.float64) / np.maximum(np.minimum(a[:, None], b[None, :]), 1)


def _steps(x: np.ndarray, *steps: tuple[float, int]) -> np.ndarray:
    """The points of the first limit that x is above."""
    return np.select([x > limit for limit, _ in steps], [np.int8(p) for _, p in steps], np.int8(0)).astype(np.int8)


def _characters(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, character) of all titles, in order."""
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.repeat(np.arange(len(titles)), np.array([len(t) for t in titles], np.int64)), codes


def _pieces(titles: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the pieces of one or two characters, repeats told apart by their number."""
    rows, values = _characters(titles)
    if size == 2:
        inside = rows[1:] == rows[:-1]
        rows, values = rows[1:][inside], (values[:-1] << 21 | values[1:])[inside]
    order = np.lexsort([values, rows])
    rows, values = rows[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])])) if len(rows) else np.zeros(0, np.int64)
    nth = 1 + np.arange(len(rows)) - np.repeat(new, np.diff(np.concatenate([new, [len(rows)]])))
    return rows, values | np.minimum(nth, (1 << 21) - 1) << 42


def _may_be_alike(a: list[str], b: list[str]) -> np.ndarray:
    """Whether the edit distance of two texts can be at most three tenths of the longer length: an edit takes away one character and two pieces of two at most."""
    shape = (len(a), len(b))
    return _near([len(t) for t in a], [len(t) for t in b], *[_common(_pieces(a, n), _pieces(b, n), shape) for n in (1, 2)])


def _near(la: list[int], lb: list[int], ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    """Whether texts of such lengths, with so many characters and pieces of two in common, can be so alike."""
    n = np.maximum(np.array(la, np.int64)[:, None], np.array(lb, np.int64)[None, :])
    edits = np.ceil(n * 0.3)
    return (ones >= n - edits) & (twos >= n - 1 - 2 * edits)


def edits(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The edit distances of a[i] and b[j], for all pairs at once: a column of the table of distances is held as the bits of its steps up and down, 64 rows in a word (Myers)."""
    out = np.zeros(len(i), np.int64)
    la, lb = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    words = max(1, -(-int(la.max(initial=0)) // 64))
    (row_a, own_a), (row_b, own_b) = _characters(a), _characters(b)
    alphabet, code_b = np.unique(own_b, return_inverse=True)
    held = np.zeros((len(a), len(alphabet), words), np.uint64)
    if len(alphabet):
        at = np.minimum(np.searchsorted(alphabet, own_a), len(alphabet) - 1)
        k = np.arange(len(own_a)) - np.repeat(np.cumsum(la) - la, la)
        known = alphabet[at] == own_a
        # Places are different bits, so their sum is what they are together.
        np.add.at(held, (row_a[known], at[known], k[known] >> 6), np.uint64(1) << (k[known] & 63).astype(np.uint64))
    codes = np.zeros((len(b), int(lb.max(initial=0))), np.int64)
    codes[row_b, np.arange(len(own_b)) - np.repeat(np.cumsum(lb) - lb, lb)] = code_b.reshape(-1)
    one, top = np.uint64(1), np.uint64(63)
    longest = np.argsort(-lb[j], kind="stable")
    for start in range(0, len(i), AT_ONCE):
        own = longest[start : start + AT_ONCE]
        x, y = i[own], j[own]
        n = lb[y]
        up, down = [np.full(len(own), ~np.uint64(0)) for _ in range(words)], [np.zeros(len(own), np.uint64) for _ in range(words)]
        for step in range(int(n.max(initial=0))):
            # Texts are in the order of their lengths, so those that go on are the first.
            live = int(np.searchsorted(-n, -step, side="left"))
            same = held[x[:live], codes[y[:live], step]]
            rise, fall = one, np.uint64(0)
            for w in range(words):
                pv, mv, eq = up[w][:live], down[w][:live], same[:, w]
                xv = eq | mv
                eq = eq | fall
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                next_rise, next_fall = ph >> top, mh >> top
                ph, mh = (ph << one) | rise, (mh << one) | fall
                up[w][:live], down[w][:live] = mh | ~(xv | ph), ph & xv
                rise, fall = next_rise, next_fall
        total = n.copy()
        for w in range(words):
            bits = np.clip(la[x] - 64 * w, 0, 64)
            mask = np.where(bits == 64, ~np.uint64(0), (one << np.minimum(bits, 63).astype(np.uint64)) - one)
            total += np.bitwise_count(up[w] & mask).astype(np.int64) - np.bitwise_count(down[w] & mask).astype(np.int64)
        out[own] = total
    return out


def _alike(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What like titles add to the pairs (i, j), as score.alike_score() tells."""
    (own_a, at_a), (own_b, at_b) = (np.unique(np.array(x, object), return_inverse=True) for x in (a, b))
    pairs, back = np.unique(at_a.reshape(-1)[i] * len(own_b) + at_b.reshape(-1)[j], return_inverse=True)
    x, y = pairs // len(own_b), pairs % len(own_b)
    n = np.maximum(np.array([len(t) for t in own_a], np.int64)[x], np.array([len(t) for t in own_b], np.int64)[y])
    alike = np.where(n == 0, 1.0, (n - edits(list(own_a), list(own_b), x, y)) / np.maximum(n, 1))
    return _steps(alike, (0.85, 25), (0.7, 15))[back.reshape(-1)]


class Found:
    """Which pairs are wanted: all that reach `least` hundredths, or the `most` best ones of these; of pairs after (hundredths, smaller id, larger id) in the order of score and ids, where that is given.

    What a task has found tells what its later tiles must reach: a pair below as many better ones is none of the best.
    """

    def __init__(self, least: float, most: int | None = None, after: tuple | None = None):
        self.least, self.most, self.after, self.best = least, most, after, []

    def kept(self, reached: np.ndarray, rank_a: np.ndarray, rank_b: np.ndarray, told: Callable[[int, int], object]) -> np.ndarray:
        """The places of the wanted ones of pairs, by what they reach and the ranks of their ids; told(n, side) is an id itself."""
        own = np.flatnonzero(reached >= self.least - 1e-3)
        whole = np.rint(reached[own]).astype(np.int64)
        if self.after is not None:
            hundredths, *last = self.after
            level = np.flatnonzero(whole == hundredths)
            gone = whole > hundredths
            gone[level] = [tuple(sorted((told(n, 0), told(n, 1)))) <= tuple(last) for n in own[level]]
            own, whole = own[~gone], whole[~gone]
        if self.most is None or not len(own):
            return own
        # Ranks are those of the tile, which order its ids as they are.
        low, high = np.minimum(rank_a[own], rank_b[own]), np.maximum(rank_a[own], rank_b[own])
        first = np.lexsort([high, low, -whole])[: self.most]
        self.best = sorted([*self.best, *whole[first].tolist()], reverse=True)[: self.most]
        if len(self.best) == self.most:
            self.least = max(self.least, float(self.best[-1]))
        return own[first]


def compared(tile: pa.Table, kinds: pa.Table, limit: int, found: Found, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All pairs of a tile that are at most `limit` milliseconds apart and are wanted by `found`: ids and parts. `kinds` has what any two kinds of the tile add.

    The blocks of a tile are compared by BLOCK rows at a time, in the order of their times, so memory is that of a part and of the rows.
    """
    if not tile.num_rows:
        return
    tile = tile.combine_chunks()
    side, one = tile.column("_side").to_numpy(), tile.slice(0, 1).to_pylist()[0]
    alone = one["_low"] == one["_high"] and one["_i"] == one["_j"]
    sides = [tile if alone else tile.filter(pa.array(side == k)) for k in ((0,) if alone else (0, 1))]
    sides = [t.take(pa.array(np.argsort(t.column("_ms").to_numpy(), kind="stable"))) for t in sides]
    sizes = [t.num_rows for t in sides]
    if not min(sizes):
        return

    def flat(t: pa.Table, c: str) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        x = t.column(c).combine_chunks()
        n = x.value_lengths().to_numpy().astype(np.int64)
        return (np.repeat(np.arange(len(n)), n), x.flatten().to_numpy()), n

    columns = {c: [flat(t, c) for t in sides] for c in ("_title_words", "f_words", "_urls")}
    shared = {c: _Lists([x for x, _ in columns[c]], sizes) for c in columns}
    lengths = {c: [n for _, n in columns[c]] for c in columns}
    del columns
    titles = [t.column("f_title").to_pylist() for t in sides]
    pieces: list[_Lists] = []
    ids = [t.column("_id").combine_chunks() for t in sides]
    ranks = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in ids]), return_inverse=True)[1].reshape(-1)
    ranks = [ranks[: sizes[0]], ranks[-sizes[-1] :]]
    ms, new, killed = ([t.column(c).to_numpy() for t in sides] for c in ("_ms", "_new", "_killed"))
    own, at_kind = zip(*[np.unique(t.column("_kind").to_numpy(), return_inverse=True) for t in sides], strict=True)
    at_kind = [k.reshape(-1) for k in at_kind]
    met = np.searchsorted(own[0], kinds.column("kind_x").to_numpy()), np.searchsorted(own[-1], kinds.column("kind_y").to_numpy())
    by_kind = {}
    for p in BY_KIND:
        by_kind[p] = np.zeros((len(own[0]), len(own[-1])))
        by_kind[p][met] = kinds.column(p).to_numpy()
    given = sum((100 * p).astype(np.float32) for p in by_kind.values())
    for k in range(0, sizes[0], BLOCK):
        for m in range(k if alone else 0, sizes[-1], BLOCK):
            a, b = slice(k, min(k + BLOCK, sizes[0])), slice(m, min(m + BLOCK, sizes[-1]))
            if ms[-1][b.start] - ms[0][a.stop - 1] > limit or ms[0][a.start] - ms[-1][b.stop - 1] > limit:
                continue
            shape, part = (a.stop - a.start, b.stop - b.start), (k // BLOCK, m // BLOCK)
            gap = np.abs(ms[0][a, None] - ms[-1][None, b])
            wanted = (gap <= limit) & (new[0][a, None] | new[-1][None, b]) & (ranks[0][a, None] != ranks[1][None, b])
            if alone and k == m:
                wanted &= np.triu(np.ones(shape, bool), 1)
            x, y = killed[0][a, None], killed[-1][None, b]
            ratio = (np.minimum(x, y) / np.maximum(np.maximum(x, y), 1)).astype(np.float64)
            parts = {
                "s_casualty": np.where((x == 0) & (y == 0), 10, np.where((x == 0) | (y == 0), 5, np.where(ratio > 0.5, 20, np.where(ratio > 0.3, 10, 0)))).astype(np.int8),
                "s_date": np.where(gap < DAY, 10, np.where(gap < 2 * DAY, 5, 0)).astype(np.int8),
            }
            del gap, ratio
            have = given[at_kind[0][a, None], at_kind[-1][None, b]] + parts["s_casualty"] + parts["s_date"]
            left = {"s_source": 30, "s_title": 20, "s_words": 15}
            # The dear parts come last, and only where some pair can still reach what is asked for. Float32 is a few millionths of these sums away at most; what is left is summed exactly by the caller.
            for p, c, steps in (("s_source", "_urls", ()), ("s_title", "_title_words", ((0.5, 20), (0.3, 10))), ("s_words", "f_words", ((0.4, 15), (0.25, 8)))):
                wanted &= have >= found.least - MOST_ALIKE - sum(left.values()) - 1e-3
                if not wanted.any():
                    break
                common = shared[c].met(*part, shape)
                parts[p] = _steps(_overlap(common, lengths[c][0][a], lengths[c][-1][b]), *steps) if steps else np.where(common > 0, np.int8(30), np.int8(0))
                have += parts[p]
                del left[p], common
            wanted &= have >= found.least - MOST_ALIKE - 1e-3
            i, j = np.nonzero(wanted)
            if left or not len(i):
                continue
            near = np.ones(len(i), bool)
            if len(i) * FEW > shape[0] * shape[1]:
                if not pieces:
                    pieces += [_Lists([_pieces(t, n) for t in titles], sizes) for n in (1, 2)]
                near = _near(*[[len(t) for t in x] for x in (titles[0][a], titles[-1][b])], *[p.met(*part, shape) for p in pieces])[i, j]
            alike = np.zeros(len(i), np.int8)
            alike[near] = _alike(titles[0][a], titles[-1][b], i[near], j[near])
            reached = have[i, j] + alike
            kept = found.kept(reached, ranks[0][a][i], ranks[1][b][j], lambda n, c: ids[-c][(a, b)[c].start + int((i, j)[c][n])].as_py())  # noqa: B023
            i, j, alike = i[kept], j[kept], alike[kept]
            if not len(i):
                continue
            told = [alike if p == "s_alike" else parts[p][i, j] for p in PARTS]
            u, v = at_kind[0][a][i], at_kind[-1][b][j]
            out = [ids[0].take(pa.array(i + k)), ids[-1].take(pa.array(j + m)), *[pa.array(by_kind[p][u, v]) for p in BY_KIND], *[pa.array(p) for p in told]]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, schema.types, strict=True)], schema=schema)


def pairs(rows: DataFrame, kinds: DataFrame, days: int, least: float, most: int | None = None, after: tuple | None = None) -> DataFrame:
    """(id_x, id_y, the parts of the score) of the pairs of one f_state and at most `days` apart of which one row at least is `_new`, and that reach `least` hundredths but for rounding; each once. With `most` only pairs that may be among as many best ones, see Found.

    kinds (kind_x, kind_y, and the parts of BY_KIND) has what two kinds add; each tile gets what its own kinds do.
    Rows of a state and `days` days lie in blocks of about BLOCK rows, of up to WIDER times as many where that still gives each partition some tiles, for
    a row is dealt to as many tiles as there are blocks beside its own; each two blocks of the same or the next days are a tile, a group
    of its own. So no task holds more than a tile, and a state of a third of all rows is as many groups as it has pairs of blocks.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.floor(F.datediff("f_day", F.lit("1970-01-01")) / days)
    urls, words = (F.transform(c, lambda w: F.xxhash64(w)) for c in ("f_urls", "f_title_words"))
    flat = rows.where("f_day IS NOT NULL").select("_id", "f_state", bucket.alias("_b"), F.unix_millis("date").alias("_ms"), F.coalesce("killed", F.lit(0)).cast("long").alias("_killed"), "_kind", "_new", "f_title", words.alias("_title_words"), "f_words", urls.alias("_urls"))
    # A state has a row for each `days` days here.
    held = settled(rows.where("f_day IS NOT NULL").groupBy("f_state", bucket.alias("_b")).agg(F.count("*").alias("_rows"), F.max("_new").alias("_any")), "days-held")
    work = held.agg(F.sum(F.col("_rows").cast("double") * F.col("_rows"))).first()[0] or 0.0
    size = int(min(max(BLOCK, (1.5 * work / (TILES * n)) ** 0.5), WIDER * BLOCK))
    blocks = held.select("f_state", "_b", F.ceil(F.col("_rows") / size).cast("int").alias("_n"), "_any")
    beside = lambda by, n, new: blocks.select("f_state", (F.col("_b") + by).alias("_b"), F.col("_n").alias(n), F.col("_any").alias(new))
    counts = blocks.join(beside(-1, "_up", "_any_up"), ["f_state", "_b"], "left").join(beside(1, "_down", "_any_down"), ["f_state", "_b"], "left")
    own = F.col("_own")

    def tiles(n: str, new: str, low: Column, i: Column | None, high: Column, j: Column | None) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct(low.alias("_low"), (k if i is None else i).alias("_i"), high.alias("_high"), (k if j is None else j).alias("_j"), F.lit(1 if i is None else 0).alias("_side")))
        return F.when(F.col(n).isNotNull() & (F.col("_any") | F.col(new)), each).otherwise(F.array().cast("array<struct<_low:bigint,_i:int,_high:bigint,_j:int,_side:int>>"))

    b = F.col("_b")
    inside = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(b.alias("_low"), F.least(k, own).alias("_i"), b.alias("_high"), F.greatest(k, own).alias("_j"), F.when(k < own, 1).otherwise(0).alias("_side")))
    inside = F.when(F.col("_any"), inside).otherwise(F.array().cast("array<struct<_low:bigint,_i:int,_high:bigint,_j:int,_side:int>>"))
    every = F.concat(inside, tiles("_up", "_any_up", b, own, b + 1, None), tiles("_down", "_any_down", b - 1, None, b, own))
    placed = flat.join(counts, ["f_state", "_b"]).withColumn("_own", F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_n")).cast("int"))
    dealt = placed.withColumn("_t", F.explode(every)).select(*flat.columns, "_t.*")
    side = placed.select("f_state", "_kind", F.explode(every).alias("_t")).select("f_state", "_t.*", "_kind").distinct()
    alone = (F.col("_low") == F.col("_high")) & (F.col("_i") == F.col("_j"))
    first, second = side.where("_side = 0").select(*TILE, F.col("_kind").alias("kind_x")), side.where((F.col("_side") == 1) | alone).select(*TILE, F.col("_kind").alias("kind_y"))
    # Columns of their own, to be told from those of the rows that they are grouped with.
    met = first.join(second, TILE).join(kinds, ["kind_x", "kind_y"]).select(*[F.col(c).alias(c) for c in TILE], "kind_x", "kind_y", *BY_KIND)
    id_type = rows.schema["_id"].dataType
    schema = StructType([StructField("id_x", id_type), StructField("id_y", id_type), *StructType.fromDDL(", ".join([f"{p} double" for p in BY_KIND] + [f"{p} tinyint" for p in PARTS])).fields])
    arrow, limit = to_arrow_schema(schema), days * DAY
    # Rows of tiles and what their kinds add come as one group, so that what is found leaves by parts.
    extra = ["kind_x", "kind_y", *BY_KIND]
    kind_of = dict(met.dtypes)
    tiled = dealt.select("*", *[F.lit(None).cast(kind_of[c]).alias(c) for c in extra])
    known = met.select(*[F.col(c) if c in met.columns else F.lit(2).alias(c) if c == "_side" else F.lit(None).cast(t).alias(c) for c, t in tiled.dtypes])
    found = Found(least, most, after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        of_kinds = group.column("_side").to_numpy() == 2
        yield from compared(group.filter(pa.array(~of_kinds)), group.filter(pa.array(of_kinds)).select(extra), limit, found, arrow)

    # As many partitions as the session sets: by their bytes alone, AQE would leave a few tasks with all the tiles.
    return tiled.unionByName(known).repartition(n, *TILE).groupBy(*TILE).applyInArrow(run, schema)


#: Rows of a group that are handed to a function at once, about, and of a partition of such groups.
BUCKET, DEALT = 4096, 1 << 18
PLACE = ["f_place", "f_day"]


def crossing(rows: pa.Table, large: int, alike: float, schema: pa.Schema) -> pa.Table:
    """The pairs (id_a, id_b) of each tile of `rows` of different states with a shared address, both at least `large` killed, or titles that overlap by `alike` at least."""
    if not rows.num_rows:
        return schema.empty_table()
    codes = lambda x: x.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    rank = np.unique(rows.column("_id").to_numpy(), return_inverse=True)[1].reshape(-1)
    keys = [codes(rows.column("f_place")), codes(rows.column("f_day")), rows.column("_i").to_numpy(), rows.column("_j").to_numpy()]
    order = np.lexsort([rank, rows.column("_side").to_numpy(), *keys])
    rows, rank, keys = rows.take(pa.array(order)), rank[order], [k[order] for k in keys]
    state, many, second = codes(rows.column("f_state")), rows.column("killed").to_numpy() >= large, rows.column("_side").to_numpy() == 1
    lists = {}
    for c in ("f_urls", "f_tokens"):
        x = rows.column(c).combine_chunks()
        sizes = x.value_lengths().to_numpy().astype(np.int64)
        lists[c] = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.arange(len(sizes)), sizes), codes(pa.chunked_array([x.flatten()]))
    starts = np.flatnonzero(np.concatenate([[True], *[np.any([k[1:] != k[:-1] for k in keys], axis=0)]]))

    def shared(c: str, a: slice, b: slice) -> np.ndarray:
        ends, row, value = lists[c]
        x, y = (slice(ends[t.start], ends[t.stop]) for t in (a, b))
        if a == b:  # what one row alone has is in no overlap
            _, at, n = np.unique(value[x], return_inverse=True, return_counts=True)
            held = n[at.reshape(-1)] > 1
            x = y = x.start + np.flatnonzero(held)
        return _common((row[x] - a.start, value[x]), (row[y] - b.start, value[y]), (a.stop - a.start, b.stop - b.start))

    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start, end in zip(starts, [*starts[1:], len(rank)], strict=True):
        if end - start < 2:
            continue
        a = b = slice(int(start), int(end))
        if keys[2][start] != keys[3][start]:
            middle = int(start + np.searchsorted(second[a], True))
            a, b = slice(a.start, middle), slice(middle, a.stop)
        apart = state[a, None] != state[None, b]
        apart &= rank[a, None] < rank[None, b] if a == b else rank[a, None] != rank[None, b]
        if not apart.any():
            continue
        ends = lists["f_tokens"][0]
        size_a, size_b = np.diff(ends[a.start : a.stop + 1]), np.diff(ends[b.start : b.stop + 1])
        fewest = np.minimum(size_a[:, None], size_b[None, :])
        apart &= (shared("f_tokens", a, b).astype(np.float64) / np.maximum(fewest, 1) >= alike) | (shared("f_urls", a, b) > 0) | (many[a, None] & many[None, b])
        i, j = np.nonzero(apart)
        i, j = i + a.start, j + b.start
        low = rank[i] < rank[j]
        found.append((np.where(low, i, j), np.where(low, j, i)))
    ids = rows.column("_id").combine_chunks()
    return pa.Table.from_arrays([ids.take(pa.array(np.concatenate(x))).cast(t) for x, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)


def crossings(rows: DataFrame, large: int, alike: float) -> DataFrame:
    """(id_a, id_b) of the rows (_id, f_place, f_day, f_state, killed, f_urls, f_tokens) of one place and day that crossing() finds, each pair once.

    A place's day of more than BLOCK rows lies in blocks of about as many, each two of which are a tile. Tiles are dealt to buckets of
    about BUCKET rows, so that no function gets more than a few tiles, and few small groups are a call of their own.
    """
    flat = rows.where("_id IS NOT NULL AND f_place IS NOT NULL AND f_day IS NOT NULL AND f_state IS NOT NULL")
    flat = flat.select("_id", *PLACE, "f_state", F.coalesce("killed", F.lit(0)).cast("long").alias("killed"), "f_urls", "f_tokens")
    wide = settled(flat.groupBy(*PLACE).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")).where("_n > 1"), "wide-days")
    more = wide.agg(F.coalesce(F.sum(F.col("_n").cast("long") * F.col("_n") * BLOCK), F.lit(0)).alias("n")).first()["n"]
    dealt = flat.count() + more
    placed = flat.join(wide, PLACE, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_n")).cast("int"))
    own = F.col("_own")
    tiles = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(F.least(k, own).alias("_i"), F.greatest(k, own).alias("_j"), F.when(k < own, 1).otherwise(0).alias("_side")))
    tiled = placed.withColumn("_t", F.explode(tiles)).select(*flat.columns, "_t.*")
    tiled = tiled.withColumn("_bucket", F.pmod(F.xxhash64(*PLACE, "_i", "_j"), F.lit(-(-dealt // BUCKET) or 1)))
    id_type = rows.schema["_id"].dataType
    schema = StructType([StructField("id_a", id_type), StructField("id_b", id_type)])
    arrow = to_arrow_schema(schema)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dealt // DEALT))
    return tiled.repartition(n, "_bucket").groupBy("_bucket").applyInArrow(lambda t: crossing(t, large, alike, arrow), schema)
