"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; A-Z
count as a-z. In UTF-8 every byte of a non-ASCII character is 0x80 or more, so
the rule can be applied byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """The words of a list of texts, one after another."""

    data: np.ndarray  # lower-cased bytes of all texts, a line feed after each
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    doc: np.ndarray  # index of the text of each word
    hash: np.ndarray  # 64-bit hash of each word
    first: np.ndarray  # for each text the index of its first word, and one more at the end

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def scan(texts: list[bytes | None]) -> Words:
    """Find the words of each text; None has none."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    data = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    inside = _IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    start, end = edges[0::2], edges[1::2]  # the last byte is a line feed, so each word ends
    n = len(data)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(data * _power_table(_BASE, n), dtype=np.uint64, out=sums[1:])
    value = (sums[end] - sums[start]) * _power_table(_BASE_INV, n)[start]
    value = mix64(value + (end - start).astype(np.uint64))
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
    stops = np.cumsum(lengths)
    first = np.concatenate(([0], np.searchsorted(start, stops)))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, doc, value, first)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and the text of each; a text of fewer words,
    but not none, has one shingle of all its words."""
    h, first = words.hash, words.first
    count = np.diff(first)
    n = len(h)
    if n >= size:
        total = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            total += h[k : n - size + 1 + k] * np.uint64(pow(_BASE_INV, 2 * k + 1, 1 << 64))
        inside = words.doc[: n - size + 1] == words.doc[size - 1 :]
        long_hash, long_doc = mix64(total[inside]), words.doc[: n - size + 1][inside]
    else:
        long_hash, long_doc = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array(
            [sum(int(h[first[d] + k]) * pow(_BASE_INV, 2 * k + 1, 1 << 64) for k in range(count[d])) % (1 << 64) for d in short],
            dtype=np.uint64,
        )
        long_hash = np.concatenate((long_hash, mix64(extra ^ np.uint64(0x5151))))
        long_doc = np.concatenate((long_doc, short))
        order = np.argsort(long_doc, kind="stable")
        long_hash, long_doc = long_hash[order], long_doc[order]
    return long_hash, long_doc
