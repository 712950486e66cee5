"""Texts cut at their spaces get the ids of the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from talus.llm import bpe, rans


def test_ids_are_those_of_the_library(monkeypatch):
    cache = rans.PieceIds(public_tokenizers.path("byte_bpe_50k.json"), 2)
    rnd = random.Random(3)
    parts = [" ", " ", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", " \n", "\xa0", "\x85", " ", "\x1c", "word", "Été", "naïve", "it's", "'ll", "12", "1.5", ",", "...", "_", "ß", "日本", "🙂", "²", "x" * 70, "\x00"]
    texts = ["", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a   b", "a \n b", "a \n", "a\n b", "a  \nb", " \n", "don't  'll", "<|endoftext|> a b"] + ["".join(rnd.choices(parts, k=rnd.randrange(1, 14))) for _ in range(3000)]
    cut = [bpe.spaced(t, public_tokenizers.PATTERN) for t in texts]
    assert 300 < sum(c is not None for c in cut) < len(texts) - 300
    for _ in range(2):  # the second time from what is kept
        for t in texts:
            assert np.frombuffer(cache.encode(t, public_tokenizers.PATTERN), "<u2").tolist() == cache.library.encode(t, add_special_tokens=False).ids, repr(t)
    # Words go without the pattern from their second time on.
    cache.encode("some words, of a text", public_tokenizers.PATTERN)
    seen, tokens = [], rans.fast_tokens
    monkeypatch.setattr(rans, "fast_tokens", lambda t: seen.append(t) or tokens(t))
    cache.encode("some words, of a text", public_tokenizers.PATTERN)
    assert seen == ["some"]
