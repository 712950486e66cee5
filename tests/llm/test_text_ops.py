import collections
import hashlib
import io
import re
import wave
import zlib

import numpy as np
import pytest

from talus.llm import linededup, media, pii, quality
from talus.llm.common import durable

from .helpers import documents, prose, texts


def test_media_round_trip(spark):
    rows = sorted(media.media_features(durable(media.to_media(documents(spark)), "media")).collect(), key=lambda r: (r.doc_id, r.n_bytes))
    assert [r.doc_id for r in rows] == sorted(i for i, _ in texts())
    for r, (_, t) in zip(rows, sorted(texts(), key=lambda x: (x[0], len(x[1]))), strict=True):
        data = t.encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = io.BytesIO()
        with wave.open(stored, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored.getvalue()), hashlib.sha256(stored.getvalue()).hexdigest())
        frames = np.frombuffer(payload, dtype=np.uint8).astype(float) - 128
        peaks = []
        for s in range(0, len(frames) - 575, 288):
            power = np.abs(np.fft.rfft(frames[s : s + 576] * np.hanning(576)))[2:]
            peaks.append(int(power.argmax()) + 2 if power.max() > 8 else -1)
        pairs = sorted((t, peaks[t] * 4096 + peaks[t + g] * 4 + g) for t in range(len(peaks)) for g in (1, 2, 3) if t + g < len(peaks) and min(peaks[t], peaks[t + g]) >= 0)
        assert list(zip(r.peak_frames, r.peak_codes, strict=True)) == pairs and r.feature == ",".join(f"{t:x}:{c:x}" for t, c in pairs)
    same = {r.feature for r in rows if r.doc_id in (5, 6)}
    assert len(same) == 1 and same != {""}
    assert media.media_features(media.to_media(documents(spark, []))).count() == 0


def test_media_is_wav_and_peaks_are_brute_force():
    payload = media.padded(prose(3, 900).encode())
    with wave.open(io.BytesIO(media.write_wav(payload))) as w:
        assert (w.getsampwidth(), w.getnchannels()) == (1, 1) and w.readframes(10**9) == payload
    x = np.frombuffer(payload, dtype=np.uint8).astype(float) - 128
    peaks = [2 + np.abs(np.fft.rfft(x[s : s + 576] * np.hanning(576)))[2:].argmax() for s in range(0, len(x) - 575, 288)]
    want = sorted((t, peaks[t] * 4096 + peaks[t + g] * 4 + g) for t in range(len(peaks)) for g in (1, 2, 3) if t + g < len(peaks))
    at, codes = media.peak_pairs(np.frombuffer(payload, dtype=np.uint8))
    assert list(zip(at.tolist(), codes.tolist(), strict=True)) == want


def brute_lines(rows):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in rows:
        for s in t.split("\n"):
            first[key(s)] = min(first.get(key(s), i), i)
    return {i: [len(key(s)) < 10 or first[key(s)] == i for s in t.split("\n")] for i, t in rows}


@pytest.mark.parametrize("rows", [None, [], [(i, "\n".join(["The shared line of all", f"own line {i % 7} of few", "tiny", " the SHARED line of all\t"])) for i in range(60)]])
def test_line_dedup_is_brute_force(spark, rows):
    docs = documents(spark, rows)
    keep = brute_lines(texts(rows))
    bitmaps = linededup.keep_bitmaps(docs)
    got = {r.doc_id: r for r in bitmaps.collect()}
    assert set(got) == set(keep)
    for i, k in keep.items():
        assert (got[i].n_lines, got[i].n_dropped) == (len(k), k.count(False))
        assert linededup.unpacked(bytes(got[i].keep_bitmap), len(k)).tolist() == k
    new = linededup.without_repeats(docs, bitmaps)
    assert new.columns == docs.columns and new.count() == docs.count()
    for r in new.where("doc_id IS NOT NULL AND text IS NOT NULL").collect():
        lines = dict(texts(rows))[r.doc_id].split("\n")
        assert r.text == "\n".join(s for s, k in zip(lines, keep[r.doc_id], strict=True) if k) and r.n_chars == len(r.text)


def test_first_occurrences_over_partition_edges():
    import pandas as pd

    rows = pd.DataFrame({"h1": [1, 1, 1, 2, 2, 3, 3], "h2": [0] * 7, "doc_id": [5, 5, 6, 1, 2, 4, 7], "pos": [0, 1, 0, 0, 0, 0, 0]})
    for cut in range(1, 7):
        out = pd.concat(linededup.first_occurrences(iter([rows.iloc[:cut], rows.iloc[cut:]])))
        assert sorted(zip(out.kind, out.h1, out.doc_id, strict=True)) == [(0, 2, 2), (0, 3, 7), (1, 1, 5), (1, 1, 5), (1, 1, 6), (2, 3, 4)]


def junk(i):
    return " ".join(w + "###" for w in prose(i, 40 + i % 50).split()) if i % 2 else " ".join(w.upper() + "!!" for w in prose(i, 40 + i % 50).split())


def test_quality_learns_and_handles_edges(spark):
    rows = [(i, prose(i, 50 + i % 80) if i % 5 else junk(i)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = quality.train(documents(spark, rows), labels)
    got = quality.score(documents(spark, rows), model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 5 > 0) for r in held]) > 0.95
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert np.array_equal(quality.train(documents(spark, rows), flipped)["v"], model["v"])  # labels that are held out are never used
    edge = quality.score(documents(spark), model).collect()
    assert len(edge) == len(texts()) and all(0 <= r.score <= 1 for r in edge)
    assert quality.score(documents(spark, []), model).count() == 0
    none = quality.train(documents(spark, []), labels)
    assert quality.score(documents(spark), none).count() == len(texts())
    kept = quality.accepted(documents(spark, rows), model)
    assert kept.columns == documents(spark, rows).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = {"w0": 0.3, "w": rng.normal(size=50), "v": rng.normal(size=(50, 4))}
    index, value = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(model["v"][index[i]] @ model["v"][index[j]] * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
    assert quality.raw_score(model, index, value) == pytest.approx(0.3 + model["w"][index] @ value + pairs)


def test_pii(spark):
    text = "Call +1 (017) 555-7713 or mail ann.7@mail2.example.com, card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112; ip 97.51.17.173, not 997.51.17.173; on 2024-02-29 or 31/12/2023, never 2023-02-30; iban DE89 3704 0044 0532 0130 00; ssn 123-45-6789; token = \"ab9ca9b999bc9f99aa9a99e99fc9cbfc9999999e\"."
    rows = [(1, text), (2, text + " again"), (3, None), (4, ""), (5, "nothing 12 34 here, v1.2.3, 1234567 items"), (5, "nothing 12 34 here, v1.2.3, 1234567 items")]
    got = {r.doc_id: r for r in pii.pseudonymise(documents(spark, rows), b"k").collect()}
    a = got[1].text
    assert (got[1].n_email, got[1].n_phone, got[1].n_card, got[1].n_ip, got[1].n_date, got[1].n_iban, got[1].n_ssn, got[1].n_secret) == (1, 1, 2, 1, 2, 1, 1, 1)
    for value in ("017) 555-7713", "ann.7@mail2", "4111 1111 1111 1111", "4111111111111111", "97.51.17.173,", "2024-02-29", "31/12/2023", "3704 0044", "123-45-6789", "ab9ca9b999bc9f99"):
        assert value not in a.replace("997.51.17.173", "")
    for value in ("4111111111111112", "997.51.17.173", "2023-02-30"):
        assert value in a
    assert got[2].text == a + " again"
    assert got[5].text == rows[4][1] and got[5].n_replaced == 0 and got[3].text == got[4].text == ""
    cards = re.findall(r"\b\d{16}\b|\b\d{4} \d{4} \d{4} \d{4}\b", a)
    assert pii.only_digits(cards[0]) == pii.only_digits(cards[1]) and all(pii.luhn_sum(pii.only_digits(c)) % 10 == 0 for c in cards[:2])
    assert [re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", x)) for x in (a,)] != [a] and len(a) == len(text) - len("97.51.17.173") + len(re.search(r"; ip ([\d.]+),", a)[1])
    assert pii.pseudonymise(documents(spark), b"k").count() == len(texts())
    assert pii.pseudonymise(documents(spark, []), b"k").count() == 0


def test_permutation_is_one():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(i, size, b"k", b"t") for i in range(size)) == list(range(size))
    days = collections.Counter(pii.date(f"2024-01-{d:02d}", b"k") for d in range(1, 32))
    assert max(days.values()) == 1
