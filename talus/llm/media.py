"""Media columns: documents as 8-bit WAV values, read with the wave module; short-time Fourier transforms give spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import mapped, texts

FRAME, HOP, RATE = 576, 288, 8000
#: A peak is paired with the strongest peaks of so many frames after it.
FAN_OUT = 3
#: Frames transformed at once, counted from a document's first: bounds memory, and equal texts meet equal arithmetic.
CHUNK = 2048
#: Bins 0 and 1 hold the offset of the samples, not a tone.
FIRST_BIN = 2
PAD = 255

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peak_frames array<int>, peak_codes array<int>"


def write_wav(payload: bytes) -> bytes:
    """payload as the samples of a mono 8-bit WAV file."""
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    """The samples of an 8-bit WAV file."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, code) of each pair of spectral peaks: the strongest bin of a frame with that of each of the FAN_OUT frames after it.

    code = first bin * 4096 + second bin * 4 + distance in frames; frames that are silent but for their offset have no peak.
    """
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    hann = np.hanning(FRAME).astype(np.float32)
    bins = []
    for start in range(0, len(frames), CHUNK):
        x = (frames[start : start + CHUNK].astype(np.float32) - 128) * hann
        power = np.abs(np.fft.rfft(x, axis=1)[:, FIRST_BIN:])
        best = power.argmax(axis=1)
        loud = power[np.arange(len(best)), best] > 8.0
        bins.append(np.where(loud, best + FIRST_BIN, -1))
    peak = np.concatenate(bins)
    at, codes = [], []
    for gap in range(1, FAN_OUT + 1):
        first, second = peak[:-gap], peak[gap:]
        (t,) = np.nonzero((first >= 0) & (second >= 0))
        at.append(t)
        codes.append(first[t] * 4096 + second[t] * 4 + gap)
    at, codes = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((codes, at))
    return at[order].astype(np.int32), codes[order].astype(np.int32)


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as UTF-8, padded with bytes 255 to a positive multiple of 576, as a WAV value.

    Nulls: a null text is an empty one (one frame of padding), a row without doc_id goes. Repeated rows stay, each with its row. An
    empty table gives none. Only doc_id and text are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "n_bytes": np.array([len(d) for d in data], dtype=np.int64), "media": [write_wav(padded(d)) for d in data]})

    return mapped(texts(docs), run, MEDIA_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored WAV values of (doc_id, n_bytes, media) give when read back: digests and time-coded fingerprints.

    feature is "frame:code" in hexadecimal, comma-separated, in time order; peak_frames and peak_codes are the same as arrays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, n, m in zip(b["doc_id"], b["n_bytes"], b["media"], strict=True):
                payload = read_wav(m := bytes(m))
                at, codes = peak_pairs(np.frombuffer(payload, dtype=np.uint8))
                feature = ",".join([f"{t:x}:{c:x}" for t, c in zip(at.tolist(), codes.tolist(), strict=True)])
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, at, codes))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURE_SCHEMA.split(", ")])

    return mapped(media, run, FEATURE_SCHEMA)
