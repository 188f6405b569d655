"""Counts of hashed words of a text, by NumPy alone."""

from __future__ import annotations

import numpy as np

#: Bytes looked at together.
BLOCK = 1 << 20
#: Powers of an odd number modulo 2^64 and their inverses: a word's hash doesn't depend on where it stands.
POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK, 0x9E3779B97F4A7C15, np.uint64)])
INVERSE = np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def word_counts(data: bytes, terms: int, least: int = 1) -> tuple[np.ndarray, int]:
    """Counts of ``terms`` hashed words of at least ``least`` bytes, and the number of all words.

    Words are runs of bytes above the space. Prefix sums of a polynomial give each word's hash by one difference. Blocks
    end where a word does; a word that fills a block is hashed by itself.
    """
    out, words, at, all_ = np.zeros(terms), 0, 0, np.frombuffer(data, np.uint8)
    while at < len(data):
        b = all_[at : at + BLOCK]
        if at + len(b) < len(data):
            gaps = np.flatnonzero(b <= 32)
            if len(gaps):
                b = b[: int(gaps[-1]) + 1]
            else:
                size, h = _long_word(all_, at)
                words, at = words + 1, at + size
                if size >= least:
                    out[int(h >> np.uint64(40)) % terms] += 1
                continue
        inside = np.r_[False, b > 32, False]
        first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        words += len(first)
        if least > 1:
            long = last - first >= least
            first, last = first[long], last[long]
        total = np.r_[np.uint64(0), np.cumsum(b * POWERS[: len(b)], dtype=np.uint64)]
        h = (total[last] - total[first]) * INVERSE[first] * POWERS[1]
        out += np.bincount((h >> np.uint64(40)) % np.uint64(terms), minlength=terms)
        at += len(b)
    return out, words


def _long_word(data: np.ndarray, at: int) -> tuple[int, np.uint64]:
    """Length and hash of the word that begins at ``at``, a block at a time."""
    size, h, scale = 0, np.zeros(1, np.uint64), POWERS[1:2].copy()
    while at + size < len(data):
        b = data[at + size : at + size + BLOCK]
        gap = np.flatnonzero(b <= 32)
        b = b[: int(gap[0])] if len(gap) else b
        h += (b * POWERS[: len(b)]).sum(dtype=np.uint64) * scale
        size, scale = size + len(b), scale * POWERS[len(b)]
        if len(gap):
            break
    return size, h[0]
