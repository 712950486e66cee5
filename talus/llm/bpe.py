"""Byte-level BPE: pre-tokens with their positions are exploded into a global shuffle of distinct words, each is encoded once, the ids are joined back and put in place by position; decoding joins the token-byte table."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import give_back, mapped, mapped_arrow, texts

#: Characters of text in one block: documents whose distinct words are shuffled together; characters of documents packed in one row of it.
BLOCK_CHARS, ROW_CHARS = 6_000_000, 500_000
#: Words longer than this are merged with a heap.
LONG = 48

# White space as Unicode has it, whatever the library takes \s for.
_SPACE = r"\t-\r \x85\xa0  -     　"
# Texts of these characters alone mean the same to the faster library: letters are word characters but digits and underscore.
_ODD = re.compile(r"[^\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def split_pattern(pattern: str):
    """A compiled form of a tokenizer's pattern with \\s spelt out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


_compiled: dict = {}


def pre_tokens(text: str, pattern: str) -> list[str]:
    """Every match of the pattern, in order."""
    from public_tokenizers import PATTERN

    if pattern == PATTERN and not _ODD.search(text):
        return _FAST.findall(text)
    if pattern not in _compiled:
        _compiled[pattern] = split_pattern(pattern)
    return _compiled[pattern].findall(text)


# White space before and after a space: there alone is a space no border of pre-tokens.
_INNER = re.compile(r"\s (?!\S)")


def spaced(text: str, pattern: str) -> list[str] | None:
    """text cut at its spaces, where each of them begins a pre-token whatever stands around it and the faster library may be used; else None. The pieces after the first have lost their space."""
    from public_tokenizers import PATTERN

    return None if pattern != PATTERN or _ODD.search(text) or _INNER.search(text) else text.split(" ")


def fast_tokens(text: str) -> list[str]:
    """pre_tokens() of a piece of a text that spaced() has cut."""
    return _FAST.findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file (base64 and rank on each line): its vocabulary bounds it."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: neighbours of least rank are joined, leftmost first, until none can be."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], 1 << 30) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < 1 << 30:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() with a heap of pairs and linked places: n log n for words of any length."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    rank = lambda i: ranks.get(word[i : end[after[i]]]) if after[i] < n else None
    heap = [(r, i, end[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != to:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


_codec = pa.Codec("zstd", compression_level=1)


def squeezed(data: bytes) -> bytes:
    """data compressed, its length before it."""
    return len(data).to_bytes(4, "little") + _codec.compress(data, asbytes=True)


def unsqueezed(x: bytes) -> bytes:
    return _codec.decompress(memoryview(x)[4:], int.from_bytes(x[:4], "little"), asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed byte by byte: most of the high bytes are zero."""
    return squeezed(np.ascontiguousarray(x, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueezed(x), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


#: A row of a block: documents as positions among the block's words (seq from 0 on), the bucket of each word (HEAD), or the packed
#: words of one bucket (WORDS); `check` is the checksum of all the block's words.
BLOCK_ROWS = "block long, seq int, bucket int, doc_ids binary, sizes binary, data binary, check long"
HEAD, WORDS = -1, -2


def _blocks(pattern: str, buckets: int, block_chars: int):
    """The rows of each block of documents (a piece of an input partition), its words numbered from the most frequent on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, chars, slots = TaskContext.get().partitionId() << 32, 0, {}
        ids, counts, at, lengths = [], [], [], []

        def close() -> Iterator[pd.DataFrame]:
            flat = np.concatenate([np.zeros(0, dtype=np.uint32), *at])
            order = np.argsort(-np.bincount(flat, minlength=len(slots)), kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            seen = [w.encode("utf-8", "surrogatepass") for w in slots]
            words = [seen[i] for i in order.tolist()]
            check = zlib.crc32(b"\0".join(words))
            bucket = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.uint32)
            by_bucket = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            rows = [(block, HEAD, -1, b"", b"", _planes(bucket), check)]
            for k in range(buckets):
                if ends[k] < ends[k + 1]:
                    own = [words[i] for i in by_bucket[ends[k] : ends[k + 1]].tolist()]
                    rows.append((block, WORDS, k, b"", _planes(np.array([len(w) for w in own])), squeezed(b"".join(own)), check))
            cut, begin = np.cumsum(lengths) // ROW_CHARS, np.cumsum(counts) - np.array(counts)
            start = 0
            for seq, end in enumerate([*(np.nonzero(np.diff(cut))[0] + 1).tolist(), len(ids)]):
                places = rank[flat[begin[start] : begin[end - 1] + counts[end - 1]]]
                rows.append((block, seq, -1, np.array(ids[start:end], dtype="<i8").tobytes(), np.array(counts[start:end], dtype="<u4").tobytes(), _planes(places), check))
                start = end
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCK_ROWS.split(", ")])
            for x in (slots, ids, counts, at, lengths):
                x.clear()

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                words = pre_tokens(text, pattern)
                for w in words:
                    if w not in slots:
                        slots[w] = len(slots)
                ids.append(doc_id)
                counts.append(len(words))
                lengths.append(len(text) + 1)
                at.append(np.fromiter(map(slots.__getitem__, words), dtype=np.uint32, count=len(words)))
                chars += len(text)
                if chars >= block_chars:
                    yield from close()
                    block, chars = block + 1, 0
        if ids:
            yield from close()

    return run


def _only_words(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with words. A filter that Spark knew would be moved below the exchange, which would then run once for each reader."""
    for b in pieces:
        yield b.filter(pc.equal(b.column(1), WORDS)).select([0, 2, 4, 5, 6])


def _encode_words(table, kind: str):
    """(block, bucket, sizes, ids, check) of packed words in order of bucket: within one, each distinct word is merged once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, bucket, known, width = table.value, None, {}, np.dtype(kind).itemsize
        for b in batches:
            rows = []
            for block, k, sizes, words, check in zip(b["block"], b["bucket"], b["sizes"], b["data"], b["check"], strict=True):
                if k != bucket:
                    bucket, known = k, {}
                size, data = _unplanes(sizes).astype(np.int64), unsqueezed(words)
                ends, own = np.cumsum(size), []
                for s, e in zip((ends - size).tolist(), ends.tolist(), strict=True):
                    w = data[s:e]
                    if (ids := known.get(w)) is None:
                        ids = known[w] = np.array(merge(w, ranks), dtype=kind).tobytes()
                    own.append(ids)
                rows.append((block, k, _planes(np.array([len(x) // width for x in own])), squeezed(b"".join(own)), check))
            yield pd.DataFrame(rows, columns=["block", "bucket", "sizes", "ids", "check"])

    return run


Finish = Callable[[np.ndarray, list[np.ndarray]], pd.DataFrame]


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int, finish: Finish, schema: str) -> DataFrame:
    """What `finish` makes of (doc_ids, token ids of each), a packed row of documents at a time."""
    spark, base = docs.sparkSession, texts(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"
    table = spark.sparkContext.broadcast(ranks)
    # One exchange for both readers: the words of a block and its documents come from the same run over docs.
    blocks = mapped(base, _blocks(pattern, n, block_chars), BLOCK_ROWS).repartition(n, "block")
    words = mapped_arrow(blocks, _only_words, "block long, bucket int, sizes binary, data binary, check long")
    replies = mapped(words.repartition(n, "bucket").sortWithinPartitions("bucket", "block"), _encode_words(table, kind), "block long, bucket int, sizes binary, ids binary, check long")

    def reassemble(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        head = right[right["seq"] == HEAD]
        if len(head) != 1 or set(left["check"]) | {head["check"].iloc[0]} != set(right["check"]):
            raise ValueError("a block and the ids of its words come from different runs over the documents: write the input to a table first")
        left, right = left.sort_values("bucket"), right[right["seq"] >= 0].sort_values("seq")
        order = np.argsort(_unplanes(head["data"].iloc[0]), kind="stable")
        sizes = np.concatenate([np.zeros(0, dtype=np.uint32), *[_unplanes(x) for x in left["sizes"]]]).astype(np.int64)
        flat = np.frombuffer(b"".join([unsqueezed(x) for x in left["ids"]]), dtype=kind)
        size, begin = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
        size[order], begin[order] = sizes, np.cumsum(sizes) - sizes
        out = []
        for doc_ids, counts, slots in zip(right["doc_ids"], right["sizes"], right["data"], strict=True):
            at, ends = _unplanes(slots), np.cumsum(np.frombuffer(counts, dtype="<u4").astype(np.int64))
            m = size[at]
            upto = np.concatenate([[0], np.cumsum(m)])
            tokens = flat[np.repeat(begin[at] - upto[:-1], m) + np.arange(upto[-1])].astype("<u4")
            out.append(finish(np.frombuffer(doc_ids, dtype="<i8"), np.split(tokens, upto[ends[:-1]])))
        give_back()
        return pd.concat(out, ignore_index=True)

    return replies.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(reassemble, schema)


def _as_bytes(doc_ids: np.ndarray, tokens: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": doc_ids, "ids": [x.tobytes() for x in tokens]})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) of every row of docs: the token ids of its whole text as little-endian unsigned 32-bit integers in one binary value.

    A null or empty text has no ids; rows without doc_id go; repeated rows each have a result; an empty table gives an empty one;
    a text of any length is taken whole; only doc_id and text are read.

    Documents are read once, in blocks (pieces of input partitions). A block gives its distinct words to the buckets of a global
    shuffle, where each distinct word is merged once, and its documents as positions among its words; ids go back to the block and
    into place by position. So a frequent word is one entry a block, not one a place. Should a task be run again over other rows
    or in another order, the checksum of a block's words differs from that of the ids that come back, and the job raises.
    """
    return _encoded(docs, ranks, pattern, block_chars, _as_bytes, "doc_id long, ids binary")


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded (doc_id, ids) with the bytes `decoded`: each id meets the token-byte table, which has a row for each of the vocabulary."""
    shared = encoded.sparkSession.sparkContext.broadcast(_tokens(ranks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.__getitem__
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": b["ids"], "decoded": [b"".join(map(get, np.frombuffer(x, dtype="<u4").tolist())) for x in b["ids"]]})

    return mapped(encoded, run, "doc_id long, ids binary, decoded binary")


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids, decoded) of every row of docs: encode() and decode(), decoded where the ids are put in place."""
    shared = docs.sparkSession.sparkContext.broadcast(_tokens(ranks))

    def finish(doc_ids: np.ndarray, tokens: list[np.ndarray]) -> pd.DataFrame:
        get = shared.value.__getitem__
        return _as_bytes(doc_ids, tokens).assign(decoded=[b"".join(map(get, x.tolist())) for x in tokens])

    return _encoded(docs, ranks, pattern, block_chars, finish, "doc_id long, ids binary, decoded binary")


def encoded_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and ids where asked for) of every row of docs, as encode_decode() without giving the bytes out.

    ids_sha256 is that of the decimal ids joined by commas, decoded_sha256 that of the decoded bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_tokens(ranks))

    def finish(doc_ids: np.ndarray, tokens: list[np.ndarray]) -> pd.DataFrame:
        get, ids = shared.value.__getitem__, [x.tolist() for x in tokens]
        out = pd.DataFrame({
            "doc_id": doc_ids, "n_tokens": np.array([len(x) for x in ids], dtype=np.int64), "ids_sha256": [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(b"".join(map(get, x))).hexdigest() for x in ids],
        })
        return out.assign(ids=[x.tobytes() for x in tokens]) if with_ids else out

    return _encoded(docs, ranks, pattern, block_chars, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
