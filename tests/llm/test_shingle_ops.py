import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from talus.llm import bpe, decontaminate, licenses, neardup, rans, suffix

from .helpers import documents, prose, texts


def words(t):
    return t.encode().lower().split()


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                a1, b1 = find(a), find(b)
                up[max(a1, b1)] = min(a1, b1)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, seed, rate):
    r = random.Random(seed)
    return " ".join(w if r.random() > rate else f"new{r.randrange(10**6)}" for w in text.split())


def chains():
    """Families in which some links hold only through others, near the threshold on both sides."""
    rows, k = [], 100
    for f in range(4):
        text = prose(50 + f, 200)
        for step in range(12):
            rows.append((k, text))
            rows.append((k + 1, edited(text, k, 0.04)))
            text, k = edited(text, k, (0.02, 0.035, 0.05, 0.08)[f]), k + 2
    return rows


@pytest.mark.parametrize("rows", [None, [], chains(), [(i, edited(prose(9, 150), i, 0.03)) for i in range(120)]])
def test_near_duplicates_are_brute_force(spark, rows):
    for size, percent in ((4, 80), (5, 80)):
        want = brute_components(texts(rows), size, percent)
        got = neardup.near_duplicates(documents(spark, rows), size, percent).collect()
        assert len(got) == len(texts(rows))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = [(i, edited(prose(9, 150), i, 0.03)) for i in range(60)]
    got = neardup.near_duplicates(documents(spark, rows), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 80)


def test_posterior_bound():
    from math import comb

    for n, m in zip(range(25, 126, 25), neardup.least_matches(0.8), strict=True):
        tail = lambda m: sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))  # noqa: B023, E731
        assert tail(m) >= neardup.MISS > tail(m - 1)


def test_decontamination(spark):
    items = [(i, prose(1000 + i, 30)) for i in range(12)] + [(20, ""), (21, None), (22, "tiny item")]
    rows = []
    for d in range(120):
        text = prose(d, 150).split()
        if d % 10 == 0:
            text[40:40] = items[d // 10][1].upper().replace(" ", ", ").split()
        if d % 10 == 1:
            text[90:90] = edited(items[d // 10][1], d, 0.1).split()
        if d % 10 == 2:
            text[10:10] = items[d // 10][1].split()[:6]
        rows.append((d, " ".join(text)))
    rows += [(500, "A tiny item, here."), (501, None), (502, ""), (503, items[0][1]), (503, items[0][1])]
    tests = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, words string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(documents(spark, rows), tests).collect()}
    want = {(d, d // 10) for d in range(120) if d % 10 in (0, 1)} | {(500, 22), (503, 0)}
    assert set(got) == want
    assert got[10, 1].score == 1.0 and (got[10, 1].first_word, got[10, 1].end_word) == (40, 70)
    assert decontaminate.find_leaks(documents(spark, []), tests).count() == 0
    assert decontaminate.find_leaks(documents(spark), tests.limit(0)).count() == 0


def test_alignment_is_brute_force():
    r = random.Random(3)
    for _ in range(60):
        a, b = [r.choice("abcd").encode() for _ in range(r.randrange(1, 9))], [r.choice("abcde").encode() for _ in range(r.randrange(0, 14))]
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        assert decontaminate.smith_waterman(a, b)[0] == best / (2 * len(a))


def brute_repeats(rows, window=400):
    seen = {}
    raw = [t.encode() for _, t in rows]
    for r in raw:
        for k in range(len(r) - window + 1):
            seen[r[k : k + window]] = seen.get(r[k : k + window], 0) + 1
    out = []
    for (i, _), r in zip(rows, raw, strict=True):
        gone = bytearray(len(r))
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(r), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return sorted(out)


def passages():
    shared, rows = [prose(70 + k, 90) for k in range(3)], []
    for d in range(40):
        text = prose(d, 60).split()
        text[20:20] = shared[d % 3].split()[d % 5 : 90 - d % 7]
        rows.append((d, " ".join(text)))
    return [*rows, (90, "abc " * 300), (91, "x" * 399), (92, "y" * 401)]


@pytest.mark.parametrize("rows", [None, [], passages()])
@pytest.mark.parametrize("together", [512, 2])
def test_repeats_are_brute_force(spark, monkeypatch, rows, together):
    monkeypatch.setattr(suffix, "TOGETHER", together)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(documents(spark, rows)).collect())
    assert got == brute_repeats(texts(rows))


def test_groups_hold_all_occurrences(spark, monkeypatch):
    """Each group's strings are equal, all places that have the string are listed, and what the groups cover is what goes."""
    rows = passages()
    raw = {i: t.encode() for i, t in rows}
    for together in (512, 3):
        monkeypatch.setattr(suffix, "TOGETHER", together)
        groups, covered = {}, {i: bytearray(len(t)) for i, t in raw.items()}
        for g in suffix.repeat_groups(documents(spark, rows)).collect():
            groups.setdefault((g.k1, g.k2, g.group), []).append((g.doc_id, g.first, g.length))
            covered[g.doc_id][g.first : g.first + g.length] = b"\1" * g.length
        for places in groups.values():
            strings = {raw[i][s : s + n] for i, s, n in places}
            assert len(strings) == 1 and len(next(iter(strings))) >= 400 and len(places) > 1
            if together == 512:
                string = next(iter(strings))
                assert {(i, k) for i, t in raw.items() for k in range(len(t)) if t.startswith(string, k)} == {(i, s) for i, s, _ in places}
        assert {i: sum(c) for i, c in covered.items()} == {r[0]: r[2] for r in brute_repeats(texts(rows))}


def test_intervals_and_extents(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(suffix, "SEGMENT", 500)
    for _ in range(30):
        n = r.randrange(2, 12)
        lefts = [r.randrange(0, 8) for _ in range(n)]
        contexts = list({("".join(r.choice("ab") for _ in range(x)) + "###" + "".join(r.choice("ab") for _ in range(r.randrange(1, 8)))).encode(): None for x in lefts})
        lefts = [c.index(b"#") for c in contexts]
        copies = [r.randrange(1, 3) for _ in range(n)] if r.random() < 0.3 else [1] * n
        copies = copies[: len(contexts)]
        groups = list(suffix.maximal_groups(contexts, lefts, copies, 7, inner=r.random() < 0.5))
        before, after = suffix.extents(groups, len(contexts))
        for least, length, members, left in groups:
            if len(members) == 1:
                assert copies[members[0]] > 1 and (length, left[0]) == (len(contexts[members[0]]) - lefts[members[0]], lefts[members[0]])
                continue
            strings = {contexts[m][lefts[m] - least : lefts[m] + length] for m in members}
            assert len(strings) == 1 and least + length >= 7
            assert least <= left.min()
            # All with this string are members, and they differ on both sides.
            assert {m for m, c in enumerate(contexts) if lefts[m] >= least and c[lefts[m] - least : lefts[m] + length] in strings} == set(members.tolist())
            for ends in ({contexts[m][lefts[m] + length : lefts[m] + length + 1] or m for m in members}, {contexts[m][: lefts[m] - least][-1:] or m for m in members}):
                assert len(ends) > 1
        for i, c in enumerate(contexts):
            best = [0, 0]
            for j, d in enumerate(contexts):
                if i != j:
                    left = next((k for k in range(min(lefts[i], lefts[j])) if c[lefts[i] - 1 - k] != d[lefts[j] - 1 - k]), min(lefts[i], lefts[j]))
                    x, y = c[lefts[i] :], d[lefts[j] :]
                    right = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
                    if left + right >= 7:
                        best = [max(best[0], left), max(best[1], right)]
            if copies[i] > 1:
                best = [lefts[i], len(c) - lefts[i]]
            assert [before[i], after[i]] == best
    text = np.frombuffer(prose(8, 400).encode(), dtype=np.uint8)
    fp, at, first, last = suffix.anchors(text)
    assert first[0] == 0 and last[-1] == len(text) - 400 and (first[1:] == last[:-1] + 1).all() and (at >= first).all() and (at + 64 <= last + 400).all()


def test_licenses(spark):
    rows = [
        (1, "src/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "src/a/b/x.py", "no notice"), (3, "src/a/COPYING", "Released under the MIT License."),
        (4, "src/a/y.py", "All rights reserved."), (5, "src/a/b/c/z.py", None), (6, "other/q.py", ""), (7, None, "Licensed under CC BY-NC 4.0."), (8, "root.py", "I licensed the idea to my friends for the summer party."),
        (2, "src/a/b/x.py", "no notice"), (None, "src/n.py", "x"), (9, "src/w.py", "first line\nThis work is licensed under the GNU General Public License, version 3. And so on."),
    ]
    files = spark.createDataFrame([(i, p, t, "k") for i, p, t in rows], "file_id long, path string, text string, token string")
    got = {r.file_id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(files).collect()}
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", "src"), 2: (None, "MIT", "src/a"), 3: ("MIT", "MIT", "src/a"), 4: ("All-Rights-Reserved", "All-Rights-Reserved", "src/a"), 5: (None, "MIT", "src/a"),
        6: (None, None, None), 7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 8: (None, None, None), 9: ("GPL-3.0", "GPL-3.0", "src"),
    }
    assert licenses.scan(files).count() == 10 and licenses.scan(files.limit(0)).count() == 0


def public(name):
    P = pytest.importorskip("public_tokenizers")
    return P.path(name), P.PATTERN


@pytest.mark.parametrize("block", [40_000_000, 300])
@pytest.mark.parametrize("rows", [None, [], [(i, prose(i, 100)) for i in range(300)]])
def test_bpe_is_the_library(spark, rows, block):
    import tiktoken


    path, pattern = public("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id, np.frombuffer(bytes(r.ids), dtype="<u4").tolist(), bytes(r.decoded)) for r in bpe.encode_decode(documents(spark, rows), ranks, pattern, block).collect())
    assert got == sorted((i, library.encode_ordinary(t), t.encode()) for i, t in texts(rows))
    d = {r.doc_id: r for r in bpe.encoded_digests(documents(spark, rows), ranks, pattern, block).collect()}
    for i, t in texts(rows):
        assert d[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and d[i].ids_sha256 == hashlib.sha256(",".join(map(str, library.encode_ordinary(t))).encode()).hexdigest()


def test_bpe_reads_its_input_once(spark):
    """Rows in another order at each run: ids and documents still come from one run, so the result is whole; and the decoder works on stored ids."""
    from pyspark.sql import functions as F

    path, pattern = public("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    rows = [(i, prose(i, 40)) for i in range(200)]
    coded = bpe.encode(documents(spark, rows).repartition(3).orderBy(F.rand()), ranks, pattern, 2000)
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(coded, ranks).collect()}
    assert got == dict(rows)


def test_merges_of_long_words():
    import tiktoken

    path, pattern = public("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    for n in (1, 3, 47, 48, 49, 200, 3000):
        for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "é日🙂"):
            w = "".join(r.choice(alphabet) for _ in range(n))
            assert bpe.merge(w.encode(), ranks) == bpe._merge_long(w.encode(), ranks) == [x for p in bpe.pre_tokens(w, pattern) for x in library.encode_ordinary(p)] or len(bpe.pre_tokens(w, pattern)) > 1
            assert [x for p in bpe.pre_tokens(w, pattern) for x in bpe.merge(p.encode(), ranks)] == library.encode_ordinary(w)


@pytest.mark.parametrize("rows", [None, [], [(i, prose(i, 3000)) for i in range(50, 0, -1)]])
def test_rans_round_trip(spark, monkeypatch, rows):
    from tokenizers import Tokenizer

    path, pattern = public("byte_bpe_50k.json")
    library, start = Tokenizer.from_file(path), 0
    got = {}
    for r in rans.round_trip(documents(spark, rows), path, pattern, 2).orderBy("start").collect():
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
        got.setdefault(r.doc_id, []).append(np.frombuffer(bytes(r.ids), dtype="<u4").tolist())
    assert list(got) == sorted(got) and sum(map(len, got.values())) == len(texts(rows))
    for i, t in texts(rows):
        assert got[i][0] == [*library.encode(t, add_special_tokens=False).ids, 2]


def test_rans_reads_single_documents(spark, tmp_path):
    path, pattern = public("byte_bpe_50k.json")
    rows = [(i, prose(i, 300)) for i in range(60)]
    rans.write_blocks(documents(spark, rows), str(tmp_path / "ids"), path, pattern, 2)
    every = {r.doc_id: bytes(r.ids) for r in rans.read_blocks(spark, str(tmp_path / "ids")).collect()}
    wanted = spark.createDataFrame([(3,), (3,), (59,), (1000,)], "doc_id long")
    assert {r.doc_id: bytes(r.ids) for r in rans.read_documents(spark, str(tmp_path / "ids"), wanted).collect()} == {i: every[i] for i in (3, 59)}


def test_rans_of_other_vocabularies(spark, tmp_path):
    """A large vocabulary takes four bytes an id; a file with a normaliser encodes whole texts; too large a vocabulary is refused."""
    import json

    from tokenizers import Tokenizer

    path, pattern = public("byte_bpe_50k.json")
    told = json.load(open(path))
    told["normalizer"] = {"type": "Lowercase"}
    own = tmp_path / "own.json"
    own.write_text(json.dumps(told))
    library, rows = Tokenizer.from_file(str(own)), [(1, "Hello THERE world"), (2, "ÄRGER und Ruhe")]
    for end in (2, 70_000):
        got = {r.doc_id: np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in rans.round_trip(documents(spark, rows), str(own), pattern, end).collect()}
        assert got == {i: [*library.encode(t, add_special_tokens=False).ids, end] for i, t in rows}
    with pytest.raises(ValueError):
        rans.id_width((1 << 20) + 1)


def test_rans_blocks():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 70_000, 300_000):
        ids = np.minimum(rng.geometric(0.01, n), 50_000).astype(np.uint32)
        table = rans.Table(rans.scaled(np.bincount(ids, minlength=1 << 16)) if n else np.zeros(1 << 16, dtype=np.int64))
        block = rans.encode_block(ids, table)
        assert (rans.decode_block(block, table) == ids).all()
        checks = rans._HEAD.unpack_from(block)[5]
        step = rans.CHECK_STEPS * rans.LANES
        for k in range(checks):
            assert (rans.decode_block(block, table, k, k + 1) == ids[k * step : (k + 1) * step]).all()
            assert (rans.decode_block(block, table, k) == ids[k * step :]).all()
        for a, b in [(0, 1), (n // 2, n // 2 + 700), (n - 1, n)]:
            if 0 <= a < b <= n:
                first, last, before = rans.checkpoint_range(block, a, b)
                assert (rans.decode_block(block, table, first, last)[a - before : b - before] == ids[a:b]).all()
        if n > 600:
            broken = bytearray(block)
            broken[-5] ^= 1
            with pytest.raises((ValueError, IndexError)):
                rans.decode_block(bytes(broken), table)
    assert zlib.crc32(b"") == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(i, 80) + "\nThis line stands in all documents") for i in range(60)]
    rows += [(100 + i, " ".join(w + "###" for w in prose(i, 60).split())) for i in range(20)] + [(200, prose(3, 80) + " end"), (201, prose(900, 50) + " " + prose(1000, 30))]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 120], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(1000, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(60))
    assert out[5].decoded_sha256 == hashlib.sha256(prose(5, 80).encode()).hexdigest()
    assert out[0].decoded_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns


def test_pipeline_edges(spark, tmp_path):
    """Null, empty, repeated and unnamed rows, a text whose lines all go, and empty tables, stage by stage."""
    import corpus_pipeline

    line = "This very line stands in several documents"
    rows = [(i, prose(i, 60)) for i in range(40)] + [(100, None), (101, ""), (102, line), (103, line), (104, f"{prose(200, 50)}\n{line}"), (105, prose(201, 50)), (105, prose(201, 50)), (None, prose(202, 50)), (106, prose(203, 30_000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gram string, key string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "g", "k") for i, t in rows], schema)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for table, name in zip(empty, ("labels", "benchmark"), strict=True):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    got = {}
    for r in now.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert set(got) == {i for i, _ in rows}
    assert got[100] == [None] and got[101] == [""] and got[102] == [line] and got[103] == [""] and got[104] == [prose(200, 50)] and len(got[105]) == 2 and len(got[None]) == 1
    out = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [i for i, _ in out] == sorted(i for i, _ in rows if i is not None) and dict(out)[103] == dict(out)[100] == 0 and dict(out)[106] > 30_000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
