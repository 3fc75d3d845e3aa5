"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of texts laid end to end, A-Z as a-z, and n + 1 word offsets."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = np.zeros(n + 8, dtype=np.uint8)
    low[:n] = _LOWER[raw]
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]  # a word never runs into the next text
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    sizes = np.flatnonzero(last) + 1 - starts
    eight = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=low, strides=(1,))
    h = mix(sizes.astype(np.uint64) * _STEP)
    full = ~np.uint64(0)
    live = np.arange(len(starts))
    done = 0
    while len(live):
        left = sizes[live] - done
        word = eight[starts[live] + done] & (full >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        h[live] = mix(h[live] * _STEP + word)
        done += 8
        live = live[left > 8]
    return h, np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Per text: ascending distinct hashes of its `words`-word shingles; fewer words are one shingle, none no set."""
    h, cuts = word_hashes(raw, offsets)
    n = len(h)
    if n >= words:
        joined = np.zeros(n - words + 1, dtype=np.uint64)
        for k in range(words):
            joined = mix(joined * _STEP + h[k : n - words + 1 + k])
    else:
        joined = np.zeros(0, np.uint64)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if b - a >= words:
            yield np.unique(joined[a : b - words + 1])
        elif b > a:
            one = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                one = mix(one * _STEP + h[k : k + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed integers."""
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
