"""Word-shingle sets of whole texts as sorted arrays of 64-bit hashes."""

import functools

import numpy as np
import xxhash

#: Words whose hashes a Python worker keeps; the store is emptied when it is full.
WORD_STORE = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_STORE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.cache
def _weights(k: int) -> list[np.uint64]:
    return [np.uint64(xxhash.xxh3_64_intdigest(b"place", seed=i) | 1) for i in range(k)]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles of ``k`` words.

    A-Z is lower-cased, words are runs without ASCII white space. Fewer than ``k`` words make
    one shingle of all of them; no words, or null, make an empty set.
    """
    words = text.encode().lower().split() if text else ()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    if n < k:
        return mix(np.array([sum(int(x) * int(w) for x, w in zip(h, _weights(k), strict=False)) + n & 2**64 - 1], np.uint64))
    total = np.zeros(n - k + 1, np.uint64)
    for i, w in enumerate(_weights(k)):
        total += h[i : n - k + 1 + i] * w
    return np.unique(mix(total))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
