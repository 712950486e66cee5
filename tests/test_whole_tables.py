"""Queries over whole tables where their first forms read a part."""

import itertools
import re
from collections import Counter

from talus import catalog
from talus.functions import values
from talus.operators import dedup


def test_source_classes_hold_all_pairs(spark):
    """Membership gives the pairs of brute force, beyond any range of ids."""
    rows = [(3900 + i, f"https://a.b/{(i * j) % 7}" + "/" * (i % 2)) for i in range(0, 300, 4) for j in range(1, 5)] + [(9000, None), (9001, "")]
    sources = spark.createDataFrame(rows, "_id long, url string")
    own = {}
    for i, u in rows:
        if u:
            own.setdefault(u.rstrip("/"), set()).add(i)
    got = dedup.shared_source_classes(sources).collect()
    assert sorted((r._id, r.source, r.class_id, r.members) for r in got) == sorted((i, u, min(s), len(s)) for u, s in own.items() for i in s)
    by = {}
    for r in got:
        by.setdefault(r.source, set()).add(r._id)
    pairs = Counter(p for s in by.values() for p in itertools.combinations(sorted(s), 2))
    assert pairs == {(r.id_a, r.id_b): r.shared for r in dedup.shared_source_pairs(sources).collect()}


def test_documents_of_all_languages(spark, tmp_path):
    """Accents, curly quotes, other scripts, null text and null lang are read; results are those of brute force."""
    rows = [
        (1, "Les soldats ont tué dix bandits près de Zamfara", "fr"), (2, "Die Armee tötete zehn Kämpfer – bei Überfällen", "de"), (3, "El ejército mató a diez bandidos", "es"),
        (4, "The army’s troops killed ten bandits at the café", "en"), (5, None, "en"), (6, "Troops killed ten bandits in the north", None), (7, "日本語の文書", "ja"), (31, "Les soldats ont tué dix bandits près de Zamfara", "fr"),
        (8, "x" * 150 + "é" * 100, "fr"), (9, "plain english text of troops", "en"),
    ]
    spark.createDataFrame([(*r, "web") for r in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: catalog.QUERIES[f"{n}_all"](spark, str(tmp_path)).collect() for n in ("keyword_overlap", "normalize_text", "tokenize", "truncate", "dedup_state_scan", "dedup_global_scan", "dedup_recent", "top_candidates", "dedup_exact_cluster")}
    full = {i: t or "" for i, t, _ in rows}
    plain = {i: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s/-]", " ", t.lower(), flags=re.A), flags=re.A).strip() for i, t in full.items()}
    assert {r.doc_id: r.plain for r in got["normalize_text"]} == plain
    words = lambda t: {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", t.lower(), flags=re.A)) if len(w) >= 3 and w not in values.KEYWORD_STOPWORDS}
    assert {r.doc_id: (r.n_title, r.n_text) for r in got["keyword_overlap"]} == {i: (len(words(t[:80])), len(words(t))) for i, t in full.items()}
    tokens = {i: [w for w in re.sub(r"[^a-z0-9\s/-]", " ", t.lower(), flags=re.A).split() if len(w) >= 4 and w not in values.SOURCE_STOPWORDS] for i, t in full.items()}
    assert {r.doc_id: r.tokens.split() for r in got["tokenize"]} == tokens
    short = {r.doc_id: r.short for r in got["truncate"]}
    assert set(short) == set(full) and short[8].startswith("x" * 150 + "é" * 50)
    assert {r._id for r in got["dedup_exact_cluster"]} >= {1, 31}
    for scan in ("dedup_state_scan", "dedup_global_scan", "top_candidates"):
        assert (1, 31) in {(r.id_a, r.id_b) for r in got[scan]}, scan


def test_addresses_by_id_lie_in_partitions_of_bounded_size(spark, monkeypatch):
    """Rows of addresses come in more partitions as they grow, numbers stand for addresses, and links are those of brute force; a row without an _id is in its class and links nothing."""
    monkeypatch.setattr(dedup, "HELD", 50)
    rows = [(i, f" HTTPS://a.b/{(i * j) % 9}" + "/" * (i % 2)) for i in range(200) for j in range(1, 4)] + [(None, "https://a.b/1"), (None, "https://only.null/"), (500, None), (501, "//")]
    sources = spark.createDataFrame(rows, "_id long, url string")
    dealt, _ = dedup._address_classes(sources)
    assert dealt.rdd.getNumPartitions() >= 12 and dict(dealt.dtypes) == {"_id": "bigint", "class": "bigint", "first": "bigint"}
    own, first = {}, {}
    for i, u in rows:
        if u:
            own.setdefault(i, set()).add(re.sub("/$", "", u.strip().lower()))
    for i in sorted(x for x in own if x is not None):
        for u in own[i]:
            first.setdefault(u, i)
    want = {(first[u], i): len(own[i] & own[first[u]]) for i in own if i is not None for u in own[i] if first[u] != i}
    got = dedup.source_links(sources).collect()
    assert len(got) == len(want) and {(r.id_a, r.id_b): r.shared for r in got} == want
    assert {(r._id, r.source, r.class_id) for r in dedup.shared_source_classes(sources).collect()} == {(i, u, first.get(u)) for i, s in own.items() for u in s}
