"""Substring dedup, ranked search and the source audit, against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from talus.llm import divergence, search, substring

from .helpers import documents, prose, texts


def brute_repeats(rows):
    """(words, removed, spans, digest) of each row: every window of twenty words, by its first place."""
    words = [(i, t.encode().split()) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for p in range(len(w) - 19):
            key = b" ".join(w[p : p + 20])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[b" ".join(w[p : p + 20])] < (i, p):
                gone[p : p + 20] = [True] * 20
        spans = [(a, z) for a, z in runs(gone)]
        out.append((i, len(w), sum(gone), spans, hashlib.sha256(b" ".join([x for x, g in zip(w, gone, strict=True) if not g])).hexdigest()))
    return sorted(out)


def runs(marks):
    edges = [k for k in range(len(marks) + 1) if (k < len(marks) and marks[k]) != (k > 0 and marks[k - 1])]
    return list(zip(edges[::2], edges[1::2], strict=True))


def passages():
    """Passages of 18 to 60 words at any distance from blocks, within documents and across, copies, edits, and one that many documents hold."""
    r = random.Random(8)
    shared = [prose(700 + k, n).split() for k, n in enumerate((18, 19, 20, 21, 24, 33, 45, 60))]
    rows = []
    for i in range(120):
        w = prose(i, r.randrange(0, 80)).split()
        for _ in range(r.randrange(4)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(shared)[r.randrange(3) :]
        if i % 3 == 0:
            w[5:5] = shared[6]
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, rows[7][1]) for i in range(25)] + [(3000 + i, "\t".join(x if r.random() > 0.03 else "new" for x in rows[9][1].split())) for i in range(10)]
    return [*rows, (4000, " ".join(["word"] * 100)), (4001, " ".join(prose(1, 21).split() * 5)), (4002, "a b c " * 40)]


@pytest.mark.parametrize("rows", [None, [], passages(), [(i, prose(i % 5, 60)) for i in range(60)]])
@pytest.mark.parametrize("piece", [3000, 4_000_000])
def test_substring_dedup_is_brute_force(spark, rows, piece):
    got = substring.remove_repeats(documents(spark, rows), piece=piece).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, [(s["first"], s["last"]) for s in r.spans], hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == brute_repeats(texts(rows))


def test_hashes_go_and_come_back():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = r.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
        assert (substring.unpacked(substring.packed(x), n) == x).all() and (substring.unpacked_sorted(substring.packed_sorted(np.sort(x)), n) == np.sort(x)).all()
    # Every window holds a whole block, at any place.
    for p in range(200):
        assert any(p <= b and b + substring.BLOCK <= p + substring.WINDOW for b in range(0, 400, substring.STRIDE))


def terms(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def brute_ranks(docs, items):
    own = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t or ""))
    out = []
    for item, ts in asked.items():
        found = []
        for doc_id, c in own:
            m = 10 + (90 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, doc_id))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(found)[:10], start=1)]
    return sorted(out)


def many_documents():
    r = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    weight = [1 / (k + 1) for k in range(60)]
    rows = [(5000 - i, " ".join(r.choices(words, weight, k=r.randrange(0, 60)))) for i in range(700)]
    return rows + [(6000 + i, rows[3][1]) for i in range(30)]


@pytest.mark.parametrize("rows", [None, [], many_documents()])
def test_search_is_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 7)  # more blocks of queries than one
    r = random.Random(6)
    items = [(1, "w0 W1 w59"), (2, None), (3, ""), (4, "one ÄRGER 日本語 x two"), (4, "three"), (None, "w0 w1"), (5, "nowhere at_all"), (6, "line one is here"), (7, " ".join(f"w{k}" for k in range(60)))]
    items += [(10 + k, " ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(1, 9)))) for k in range(12)]
    asked = spark.createDataFrame([(*x, "more") for x in items], "item_id long, text string, term string")
    got = search.ranked(documents(spark, rows), asked).collect()
    assert sorted((x.item_id, x.rank, x.doc_id, x.score) for x in got) == brute_ranks(texts(rows), items)


def test_shards_of_few_documents(spark, monkeypatch):
    """Shards smaller than a task's documents: what one finds holds for the next."""
    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    shard, rows = search._Shard(7), many_documents()
    for i, t in rows:
        shard.add(i, t)
    listed = [r for b in shard.batches() for r in b.to_pylist()]
    assert listed[0]["term"] == "" and listed[0]["n"] == sum(1 for _, t in rows if t) and [r["term"] for r in listed] == sorted(r["term"] for r in listed)
    index = search.build_index(documents(spark, rows).coalesce(1))
    items = spark.createDataFrame([(1, "w0 w1 w2"), (2, "w40 w50")], "item_id long, text string")
    got = search.search(index, search.query_terms(items)).collect()
    assert sorted((x.item_id, x.rank, x.doc_id, x.score) for x in got) == brute_ranks(rows, [(1, "w0 w1 w2"), (2, "w40 w50")])


def test_blocks_are_the_best_cuts():
    """The dynamic programming, against all ways to cut short lists; longer lists are cut at atoms and their blocks cover them."""
    r = random.Random(3)
    lists = [np.array([r.choice([1, 2, 3, 50, 60, 1000]) for _ in range(r.randrange(1, 11))]) for _ in range(60)]

    def cost(x, ends):
        return sum(float(x[a:z].max()) * (z - a) - float(x[a:z].sum()) + search.OPENING * float(x.mean()) for a, z in zip([0, *ends[:-1]], ends, strict=True))

    for x, ends in zip(lists, search.variable_blocks(lists), strict=True):
        cuts = range(1, len(x))
        least = min(cost(x, [*c, len(x)]) for k in range(len(x)) for c in itertools.combinations(cuts, k))
        assert ends[-1] == len(x) and cost(x, ends.tolist()) == pytest.approx(least)
    long = [np.array([r.randrange(1, 1000) for _ in range(n)]) for n in (127, 128, 129, 5000)]
    for x, ends in zip(long, search.variable_blocks(long), strict=True):
        assert ends[-1] == len(x) and (np.diff(ends) > 0).all() and 1 < len(ends) <= search.ATOMS


def test_blocks_are_skipped():
    """A query whose best documents stand together does not look at the others' blocks."""
    n = 20_000
    scores = np.ones(n, dtype=np.int64)
    scores[500:520] = 1000
    looked = []

    class Watched(search._Postings):
        def among(self, wanted, before):
            looked.append(int(wanted.sum()))
            return super().among(wanted, before)

    p = Watched(np.arange(n), scores, search.variable_blocks([scores])[0])
    none = np.zeros(0, dtype=np.int64)
    best = search.best_of(np.arange(n), [(3, p)], (none, none))
    assert best[0].tolist() == [3000] * 10 and best[1].tolist() == list(range(500, 510))
    looked.clear()
    # With a threshold from an earlier shard nothing at all is looked at.
    assert search.best_of(np.arange(n), [(3, p)], (np.full(10, 4000), np.arange(10)))[0].tolist() == [4000] * 10 and not looked


def brute_audit(rows):
    """rows (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    n, docs = collections.Counter(), collections.Counter()
    for t, lang, source in rows:
        found = re.findall(rb"[a-z\x80-\xff]+", t.encode().lower())
        n.update((lang, source, x.decode()) for x in found)
        docs.update((lang, x.decode()) for x in set(found))
    kept = collections.defaultdict(list)
    for (lang, x), d in docs.items():
        if d >= 30:
            kept[lang].append(x)
    groups = {(lang, source) for _, lang, source in rows}
    out = []
    share = lambda count, total, v: 1 + (10**9 * (count + 5)) // (total + 5 * v)
    for lang, source in groups:
        mine, v = kept[lang], len(kept[lang])
        others = [s for x, s in groups if x == lang]
        total = {s: sum(n[lang, s, x] for x in mine) for s in others}
        p = {s: {x: share(n[lang, s, x], total[s], v) for x in mine} for s in others}
        pairs = [(-sum(abs(p[source][x] - p[s][x]) for x in mine), s.encode(), s) for s in others if s != source]
        out += [(lang, source, "pair", s, -value, k) for k, (value, _, s) in enumerate(sorted(pairs), start=1)]
        whole = {x: sum(n[lang, s, x] for s in others) for x in mine}
        q = {x: share(whole[x], sum(whole.values()), v) for x in mine}
        over = [(q[x] - p[source][x], x.encode(), x) for x in mine if n[lang, source, x] > 0 and p[source][x] > q[x]]
        out += [(lang, source, "term", x, -value, k) for k, (value, _, x) in enumerate(sorted(over)[:50], start=1)]
    return sorted(out)


def sourced():
    r = random.Random(9)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "é", "日", "ß", "zz", "q", "ÿ", "r", "s", "t")]
    rows = []
    for k in range(900):
        source = r.choice(["s0", "s0", "s0", "s1", "s2", "S2", None, ""])
        rows.append((" ".join(r.choices(words, [1 + (len(w) * (k % 5)) % 7 + i % 5 for i, w in enumerate(words)], k=r.randrange(0, 25))).upper() if k % 4 else "", r.choice(["en", "de", None]), source))
    # A language whose terms no thirty documents share, one with a single source, and one without any term.
    return rows + [("rare words here", "fr", "s0"), ("other ones", "fr", "s1"), (None, "fr", "s2"), ("alone " * 3, "es", "s0"), ("123 456", "it", "s0"), ("", "it", "s1")] + [("common", "pt", "s0")] * 30 + [("nothing", "pt", "s1")]


@pytest.mark.parametrize("rows", [[], sourced(), [("one two", "en", "s0")] * 40])
def test_audit_is_brute_force(spark, rows):
    docs = spark.createDataFrame([(k, *r, 1, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string")
    got = divergence.audit(docs).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got) == brute_audit(rows)


def test_counts_handed_on_early(spark, monkeypatch):
    """A task that counts more different terms than it holds hands its counts on in between."""
    rows = [(t, "en", "s0") for t in (prose(k, 50) for k in range(5))]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").coalesce(1)
    want = collections.Counter(x.decode() for t, *_ in rows for x in re.findall(rb"[a-z\x80-\xff]+", t.encode().lower()))
    for held in (1, 10**6):
        monkeypatch.setattr(divergence, "HELD", held)
        got = collections.Counter()
        for r in divergence.term_counts(docs).collect():
            got[r.term] += r.n
        assert got == want


