import re

import numpy as np

from tidemark.llm import terms


def test_words_are_whole_whatever_blocks_hold():
    long = b"x" * (2 * terms.BLOCK + 77)
    for data in (b"word\n" * 300_000, b"a " + long + b"\tb " + long + b" c", long, long[: terms.BLOCK], b" " * (terms.BLOCK + 5) + b"end", b""):
        words = re.findall(rb"[^\x00-\x20]+", data)
        count, n = terms.word_counts(data, 512)
        assert n == len(words) == count.sum()
        assert (count > 0).sum() <= len(set(words))
        some, m = terms.word_counts(data, 512, least=3)
        assert m == n and some.sum() == sum(len(w) >= 3 for w in words)


def test_a_long_word_has_the_hash_of_its_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(33, 256, terms.BLOCK + 1000).astype(np.uint8)
    size, got = terms._long_word(data, 0)
    powers = [1]
    for _ in range(len(data) - 1):
        powers.append(powers[-1] * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    want = sum(b * p for b, p in zip(data.tolist(), powers, strict=True)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    assert size == len(data) and int(got) == want
