"""Token-ID output: a static range asymmetric numeral system. One frequency table of all documents encodes independent blocks of interleaved streams, with checkpoints and checksums for parallel decoding."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import fast_tokens, pre_tokens, spaced
from .common import durable, mapped, shared_dir, texts

#: Frequencies are scaled to 2^PROB; states are in [2^LOW, 2^(LOW + WORD)), and WORD >= PROB, so a step moves one word at most.
PROB, LOW, WORD = 20, 31, 32
LANES = 1024
#: Ids of a block at least (a document is never cut), and steps between checkpoints inside a block.
BLOCK_IDS, CHECK_STEPS = 1 << 19, 128
MAGIC, VERSION = b"TRAN", 2
_HEAD = struct.Struct("<4sHHIIII")  # magic, version, lanes, ids, words, checkpoints, steps between them
_CHECK = struct.Struct("<II")  # words before it, crc32 of the ids from it to the next


def scaled(counts: np.ndarray) -> np.ndarray:
    """counts scaled to sum to 2^PROB, every symbol that occurs at least 1."""
    total, size = int(counts.sum()), 1 << PROB
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    out = np.where(counts > 0, np.maximum(1, counts.astype(object) * size // total).astype(np.int64), 0)
    order = np.argsort(-out, kind="stable")
    rest = size - int(out.sum())
    if rest > 0:
        out[order[0]] += rest
    for i in order if rest < 0 else ():
        take = min(-rest, int(out[i]) - 1)
        out[i] -= take
        rest += take
        if not rest:
            break
    return out


class Table:
    """Frequencies, their running sums, and the symbol of each of the 2^PROB slots."""

    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.c = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One block: head, checkpoints (words before it, checksum, states), 32-bit words. Id k is step k // LANES of stream k % LANES."""
    n, steps = len(ids), -(-len(ids) // LANES)
    x = np.full(LANES, 1 << LOW, dtype=np.uint64)
    chunks, checks = [], []
    for step in range(steps - 1, -1, -1):
        own = ids[step * LANES : (step + 1) * LANES]
        f, c, live = table.f[own], table.c[own], x[: len(own)]
        full = live >= f << np.uint64(LOW + WORD - PROB)
        chunks.append((live[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        live = np.where(full, live >> np.uint64(WORD), live)
        q = live // f
        x[: len(own)] = (q << np.uint64(PROB)) + (live - q * f) + c
        if step % CHECK_STEPS == 0:
            checks.append((step, sum(map(len, chunks)), x.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, dtype="<u4")
    parts = [_HEAD.pack(MAGIC, VERSION, LANES, n, len(words), len(checks), CHECK_STEPS)]
    for step, after, states in reversed(checks):
        own = ids[step * LANES : (step + CHECK_STEPS) * LANES]
        parts.append(_CHECK.pack(len(words) - after, zlib.crc32(own.astype("<u4").tobytes())) + states.astype("<u8").tobytes())
    return b"".join([*parts, words.tobytes()])


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block from checkpoint `first` to checkpoint `last` (or the end). All these parts are decoded at the same time, each from its checkpoint's states, and each is held against its checksum."""
    magic, version, lanes, n, n_words, n_checks, steps = _HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    size, last = _CHECK.size + 8 * lanes, n_checks if last is None else min(last, n_checks)
    if first >= last:
        return np.zeros(0, dtype=np.uint32)
    words = np.frombuffer(block, dtype="<u4", count=n_words, offset=_HEAD.size + n_checks * size).astype(np.uint64)
    checks = [_CHECK.unpack_from(block, _HEAD.size + k * size) for k in range(first, last)]
    pos = np.array([c[0] for c in checks], dtype=np.int64)
    x = np.stack([np.frombuffer(block, dtype="<u8", count=lanes, offset=_HEAD.size + k * size + _CHECK.size) for k in range(first, last)]).astype(np.uint64)
    mask, low = np.uint64((1 << PROB) - 1), np.uint64(1 << LOW)
    sizes = np.clip(n - np.arange(first, last) * steps * lanes, 0, steps * lanes)
    out = np.zeros((last - first, steps, lanes), dtype=np.uint32)
    for step in range(-(-int(sizes.max()) // lanes)):
        left = sizes - step * lanes
        on = slice(None) if left.min() >= lanes else np.arange(lanes) < left[:, None]
        slot = x & mask
        s = table.symbol[slot]
        out[:, step] = s
        new = table.f[s] * (x >> np.uint64(PROB)) + slot - table.c[s]
        need = (new < low) & (True if isinstance(on, slice) else on)
        rank = np.cumsum(need, axis=1)
        at = (pos[:, None] + rank - 1)[need]
        if len(at) and at[-1] >= n_words:
            raise ValueError("words of a block are missing")
        new[need] = new[need] << np.uint64(WORD) | words[at]
        pos += rank[:, -1]
        x = new if isinstance(on, slice) else np.where(on, new, x)
    found = [o.ravel()[:m] for o, m in zip(out, sizes, strict=True)]
    for part, (_, crc) in zip(found, checks, strict=True):
        if zlib.crc32(part.tobytes()) != crc:
            raise ValueError("checksum of a part of a block differs")
    return np.concatenate(found)


def checkpoint_range(block: bytes, first_id: int, end_id: int) -> tuple[int, int, int]:
    """(first checkpoint, last, ids before the first) between which the ids [first_id, end_id) of a block are."""
    _, _, lanes, _, _, _, steps = _HEAD.unpack_from(block)
    first = first_id // (lanes * steps)
    return first, -(-end_id // (lanes * steps)), first * lanes * steps


def id_width(vocabulary: int) -> int:
    """Bytes of an id."""
    if vocabulary > 1 << PROB:
        raise ValueError(f"a vocabulary of {vocabulary} has more ids than the {1 << PROB} slots of the frequency table")
    return 2 if vocabulary <= 1 << 16 else 4


class PieceIds(dict):
    """The ids of pre-tokens as bytes, by the tokenizers library; the first KEPT are kept in a worker.

    Texts are split here only where the file's pipeline is byte-level BPE without a normaliser, which pre_tokens() stands for; any
    other file encodes whole texts.
    """

    KEPT = 1_000_000

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library, self.width = Tokenizer.from_file(path), width
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        told = json.loads(self.library.to_str())
        split = told["pre_tokenizer"] or {}
        self.plain = told["normalizer"] is None and told["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        # Bytes as the characters that the library's byte-level models are written in.
        self.chars = {b: c for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
        self.chars |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in self.chars)}
        assert set(self.chars.values()) == set(ByteLevel.alphabet())

        self.table, self.packers = str.maketrans(self.chars), [struct.Struct(f"<{n}{'H' if width == 2 else 'I'}").pack for n in range(64)]
        self.after = SpacedIds(self)

    def ids_of(self, piece: str) -> bytes:
        """The ids of one pre-token, from the library."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.table)
        elif not piece.isalpha():
            piece = piece.replace(" ", self.chars[32]) if piece.isprintable() else piece.translate(self.table)
        ids = [t.id for t in self.model.tokenize(piece)]
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else np.array(ids, dtype=f"<u{self.width}").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        if len(self) < self.KEPT:
            self[piece] = ids
        return ids

    def encode(self, text: str, pattern: str) -> bytes:
        """As library.encode(text, add_special_tokens=False).ids; texts that spell a special token go through it whole."""
        if not self.plain or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=f"<u{self.width}").tobytes()
        cut = spaced(text, pattern)
        if cut is None:
            return b"".join(map(self.__getitem__, pre_tokens(text, pattern)))
        return b"".join([*map(self.__getitem__, fast_tokens(cut[0])), *map(self.after.__getitem__, cut[1:])])


class SpacedIds(dict):
    """The ids of what follows a space in a text that spaced() has cut, that space before it; the first KEPT that are not too long are kept.

    Pre-tokens with a space before them are kept here only, so that words alone and words with a mark behind them share them.
    """

    LONG = 32

    def __init__(self, pieces: PieceIds):
        self.pieces = pieces

    def _kept(self, word: str, ids: bytes) -> bytes:
        if len(word) <= self.LONG and len(self) < self.pieces.KEPT:
            self[word] = ids
        return ids

    def _one(self, piece: str) -> bytes:
        if not piece.startswith(" "):
            return self.pieces[piece]
        known = self.get(piece[1:])
        return self._kept(piece[1:], self.pieces.ids_of(piece)) if known is None else known

    def __missing__(self, word: str) -> bytes:
        found = fast_tokens(" " + word)
        return self._one(found[0]) if len(found) == 1 else self._kept(word, b"".join(map(self._one, found)))


def vocabulary_size(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max([end_id, *Tokenizer.from_file(path).get_vocab().values()]) + 1


_caches: dict[str, PieceIds] = {}
COUNTS = -1


def tokenised(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, width: int = 2) -> DataFrame:
    """(doc_id, n, ids): the ids of each whole text and end_id, as compressed unsigned integers of `width` bytes.

    A row of n = COUNTS ends each partition: how often it has each id, as pairs of 64-bit integers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _caches:
            _caches[tokenizer] = PieceIds(tokenizer, width)
        cache = _caches[tokenizer]
        codec, end = pa.Codec("zstd", compression_level=1), end_id.to_bytes(width, "little")
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            ids = [cache.encode(t, pattern) + end for t in b["text"]]
            counts = np.bincount(np.frombuffer(b"".join(ids), dtype=f"<u{width}"), minlength=len(total))
            counts[: len(total)] += total
            total = counts
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": np.array([len(x) // width for x in ids], dtype=np.int32), "ids": [codec.compress(x, asbytes=True) for x in ids]})
        (seen,) = np.nonzero(total)
        yield pd.DataFrame({"doc_id": [0], "n": np.array([COUNTS], dtype=np.int32), "ids": [np.stack([seen, total[seen]], axis=1).astype("<i8").tobytes()]})

    return mapped(texts(docs), run, "doc_id long, n int, ids binary")


def _unpack(ids: bytes, n: int, codec: pa.Codec, width: int) -> np.ndarray:
    return np.frombuffer(codec.decompress(ids, width * int(n), asbytes=True), dtype=f"<u{width}")


def frequencies(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, from the COUNTS rows of all partitions; the vocabulary bounds what comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["ids"]:
                pairs = np.frombuffer(x, dtype="<i8").reshape(-1, 2)
                yield pd.DataFrame({"id": pairs[:, 0].astype(np.int32), "count": pairs[:, 1]})

    out = np.zeros(vocabulary, dtype=np.int64)
    for r in mapped(counts.select("ids"), run, "id int, count long").groupBy("id").agg(F.sum("count").alias("count")).collect():
        out[r["id"]] = r["count"]
    return out


BLOCK_SCHEMA = "part int, seq int, n_ids long, doc_ids binary, sizes binary, block binary"


def write_blocks(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int, vocabulary: int | None = None) -> None:
    """The ids of docs (doc_id, text), in ascending doc_id order, as a table of blocks at `path`, with the frequency table beside it.

    A row of the table is one independent block: its range partition and place in it, the documents in it with their sizes, and the
    rANS stream of encode_block(). A null or empty text has the end id only; rows without doc_id go; rows that share a doc_id
    follow each other; an empty table gives an empty one; a text of any length is taken whole; only doc_id and text are read.
    The vocabulary is that of the file and end_id, if none is given; beyond 2^20 ids it raises ValueError.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_size(tokenizer, end_id)
    width = id_width(vocabulary)
    found = durable(tokenised(docs, tokenizer, pattern, end_id, width), "token-ids")
    tokens, f = found.where(F.col("n") != COUNTS), scaled(frequencies(found.where(F.col("n") == COUNTS), vocabulary))
    (seen,) = np.nonzero(f)
    spark.createDataFrame(pd.DataFrame({"id": seen.astype(np.int32), "frequency": f[seen].astype(np.int64)}), "id int, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(f)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, codec, table = TaskContext.get().partitionId(), 0, pa.Codec("zstd"), Table(shared.value)
        own, sizes, ids, held = [], [], [], 0

        def block() -> pd.DataFrame:
            row = (part, seq, held, np.array(own, dtype="<i8").tobytes(), np.array(sizes, dtype="<u4").tobytes(), encode_block(np.concatenate(ids), table))
            return pd.DataFrame([row], columns=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for b in batches:
            for doc_id, n, x in zip(b["doc_id"], b["n"], b["ids"], strict=True):
                own.append(doc_id)
                sizes.append(n)
                ids.append(_unpack(x, n, codec, width))
                held += int(n)
                if held >= BLOCK_IDS:
                    yield block()
                    seq, held = seq + 1, 0
                    own, sizes, ids = [], [], []
        if own:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mapped(tokens.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n", "ids"), run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _shared_table(spark: SparkSession, path: str):
    """The frequency table at `path` (the vocabulary bounds it), broadcast."""
    rows = spark.read.parquet(f"{path}/frequencies").collect()
    f = np.zeros(max((r["id"] for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        f[r["id"]] = r["frequency"]
    return spark.sparkContext.broadcast(f)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the table of blocks at `path`: blocks are decoded in parallel, and the parts of a block at the same time from its checkpoints; checksums are tested.

    start counts the ids of all documents before: those of earlier partitions (a sum for each, which their number bounds), of
    earlier blocks of the partition, and of earlier documents of the block.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    totals, before, sums = sorted((r["part"], r["s"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("s")).collect()), 0, []
    for part, s in totals:
        sums.append((part, before))
        before += s
    offsets = spark.createDataFrame(sums, "part int, before long")
    earlier = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = blocks.select("part", "seq", "n_ids").withColumn("inside", earlier).join(F.broadcast(offsets), "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))
    shared = _shared_table(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(shared.value)
        for b in batches:
            for start, doc_ids, sizes, block in zip(b["start"], b["doc_ids"], b["sizes"], b["block"], strict=True):
                ids, n = decode_block(block, table), np.frombuffer(sizes, dtype="<u4").astype(np.int64)
                at = np.cumsum(n) - n
                yield pd.DataFrame({"doc_id": np.frombuffer(doc_ids, dtype="<i8"), "start": start + at, "n_tokens": n, "ids": [x.astype("<u4").tobytes() for x in np.split(ids, at[1:])]})

    return mapped(blocks.drop("n_ids").join(places, ["part", "seq"]).select("start", "doc_ids", "sizes", "block"), run, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents in `wanted` (doc_id) alone: of the blocks that hold them, only the parts between the checkpoints around them are decoded. Ids that are not there give no row."""
    blocks = spark.read.parquet(f"{path}/blocks")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, seq, doc_ids, sizes in b[["part", "seq", "doc_ids", "sizes"]].itertuples(index=False, name=None):
                n = np.frombuffer(sizes, dtype="<u4").astype(np.int64)
                yield pd.DataFrame({"doc_id": np.frombuffer(doc_ids, dtype="<i8"), "part": part, "seq": seq, "at": np.cumsum(n) - n, "n": n})

    places = mapped(blocks.select("part", "seq", "doc_ids", "sizes"), listed, "doc_id long, part int, seq int, at long, n long")
    asked = places.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "at", "n")).alias("asked"))
    shared = _shared_table(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(shared.value)
        for b in batches:
            rows = []
            for block, asked in zip(b["block"], b["asked"], strict=True):
                for x in asked:
                    first, last, before = checkpoint_range(block, x["at"], x["at"] + x["n"])
                    rows.append((x["doc_id"], decode_block(block, table, first, last)[x["at"] - before :][: x["n"]].astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    return mapped(blocks.select("part", "seq", "block").join(asked, ["part", "seq"]).select("block", "asked"), run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, pattern: str, end_id: int) -> DataFrame:
    """Writes docs to the shared folder and reads them back: (doc_id, start, n_tokens, ids)."""
    path = f"{shared_dir(docs.sparkSession)}/rans-{uuid.uuid4().hex}"
    write_blocks(docs, path, tokenizer, pattern, end_id)
    return read_blocks(docs.sparkSession, path)
