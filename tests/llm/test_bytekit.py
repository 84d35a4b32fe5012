"""Word hashes: the constructible collision of power sums, block borders, case folding."""

from __future__ import annotations

import numpy as np
import pytest

from cohortlab.llm import bytekit as bk


def hashes(words, fold=True):
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = bk.find_words(data, np.array([0, data.size]), bk.NON_SPACE)
    return bk.hash_spans(data, starts, ends, fold).tolist()


def mirrored(n):
    """The Thue-Morse word of a and b, and its complement: power sums of the two agree modulo high powers of two."""
    word = [bin(i).count("1") % 2 for i in range(n)]
    return bytes(97 + x for x in word), bytes(98 - x for x in word)


@pytest.mark.parametrize("n", [64, 256, 257, 512, 1024, 4096, 1 << 17])
def test_constructed_words_have_different_hashes(n):
    a, b = mirrored(n)
    x, y, z = hashes([a, b, a])
    assert x != y and x == z


def test_equal_words_have_equal_hashes_wherever_they_stand():
    words = [b"w", b"long" * 80, b"x" * 600_000, b"w", b"y" * 300, b"LONG" * 80, b"x" * 600_000, b"W", b"z" * (1 << 20), b"long" * 80]
    h = hashes(words)
    assert h[0] == h[3] == h[7] and h[1] == h[5] == h[9] and h[2] == h[6] and len(set(h)) == 5
    assert hashes([w.lower() for w in words], fold=False) == h
    assert hashes([b"A" * 300, b"a" * 300], fold=False)[0] != hashes([b"a" * 300], fold=False)[0]
