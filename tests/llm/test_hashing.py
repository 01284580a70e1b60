"""Words that sums and polynomials modulo 2^64 can't tell apart must be told apart everywhere."""

from __future__ import annotations

import numpy as np
import pytest

from tests.llm.conftest import words
from worktrace.llm import hashing, hyperminhash, suffix, tokens


def thue_morse(n: int, first: str = "a", second: str = "b") -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(first if b else second for b in bits), "".join(second if b else first for b in bits)


SIZES = [64, 1024, 2048]


@pytest.mark.parametrize("n", SIZES)
def test_hashes_differ(n):
    x, y = thue_morse(n)
    a, b, c = hashing.word_hashes(f"{x} {y} {x}".encode())
    assert a == c != b


def test_equal_stretches_are_compared_to_the_last_unit():
    for dtype in (np.uint8, "<u2", "<u4"):
        for n in (1, 3, 7, 8, 9, 31, 64, 65, 700):
            units = np.tile(np.arange(n) % 200, 3).astype(dtype)
            starts, ends, other = np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]), np.array([0, 0, n])
            assert hashing.equal_stretches(units, starts, ends, other)
            units[2 * n - 1] += 1
            assert not hashing.equal_stretches(units, starts, ends, other)
            h = hashing.stretch_hashes(units, starts, ends)
            assert h[0] == h[2] != h[1]


def test_stretches_with_one_hash_are_told_apart(tokenizer, monkeypatch):
    """Were all hashes equal, ids would still be right."""
    monkeypatch.setattr(tokens, "stretch_hashes", lambda units, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    texts = ["some words of several lengths", "words, some", "a b c d e f"]
    for name, kind in (("byte_bpe_50k.json", tokens.ByteLevel), ("word_bpe_49k.json", tokens.WordLevel)):
        own, library = kind(tokenizer(name)), tokens.load(tokenizer(name))
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert own.ids(texts) == want


@pytest.mark.parametrize("n", SIZES)
def test_ids_of_colliding_words(tokenizer, n):
    texts = [*thue_morse(n), *thue_morse(n, "ab", "ba"), " ".join(thue_morse(n))]
    for name, kind in (("byte_bpe_50k.json", tokens.ByteLevel), ("word_bpe_49k.json", tokens.WordLevel)):
        own, library = kind(tokenizer(name)), tokens.load(tokenizer(name))
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert own.ids(texts) == want
        if kind is tokens.ByteLevel:
            assert own.counts(texts) == [len(w) // 4 for w in want]


@pytest.mark.parametrize("n", SIZES)
def test_passages_and_shingles_with_colliding_words(spark, n):
    x, y = thue_morse(n)
    head = words(3, 49)
    docs = spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}")], "doc_id long, text string")
    assert suffix.repeated_passages(docs).count() == 0
    text = f"{x} p q r s {y} p q r s t"
    assert len(hyperminhash.shingle_hashes(hashing.word_hashes(text.encode()))) == len(hyperminhash.shingle_set(text))
