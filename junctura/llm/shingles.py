"""Distinct word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
_VALUE = _VALUE[_LOWER]
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 20


def _grow(n: int) -> None:
    for i, base in enumerate((_BASE, _INVERSE)):
        while len(_powers[i]) < n:
            held = _powers[i]
            _powers[i] = np.concatenate([held, held * np.uint64(pow(base, len(held), 1 << 64))])


def mixed(h: np.ndarray) -> np.ndarray:
    """Well mixed bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of bytes that begin and end with white space. A-Z count as a-z."""
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    _grow(len(data))
    sums = np.cumsum(_VALUE[data] * _powers[0][: len(data)])
    return starts, mixed((sums[ends - 1] - sums[starts - 1]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def chunk_shingles(texts: list[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; of fewer than k words, all of them as one; of none, nothing."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    starts, words = word_hashes(data)
    cuts = np.searchsorted(starts, begins).tolist()
    if len(words) >= k:
        mult = np.uint64(0xD6E8FEB86659FD93)
        grams = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            grams *= mult
            grams += words[j : len(words) - k + 1 + j]
        grams = mixed(grams)
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= k:
            found = np.sort(grams[a : b - k + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = mixed(whole * np.uint64(31) + w)
            yield whole
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(batch_column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """chunk_shingles() of a column of bytes, a bounded number of bytes at a time."""
    held: list[bytes] = []
    weight = 0
    for value in batch_column:
        data = value.as_py()
        if held and weight + len(data) > CHUNK:
            yield from chunk_shingles(held, k)
            held, weight = [], 0
        held.append(data)
        weight += len(data)
    if held:
        yield from chunk_shingles(held, k)
