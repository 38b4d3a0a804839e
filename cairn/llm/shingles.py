"""Words of a text and its shingles, as 64-bit values."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words after which a worker's memo starts anew: bounds memory, never results.
MEMO_WORDS = 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_known = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """A text's words, unchanged: bytes.split() cuts at the ASCII blanks alone."""
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > MEMO_WORDS:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A value for each run of k consecutive values: a polynomial, from runs of 1, 2, 4, ... values joined, then spread."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    run, size, power = values, 1, MULTIPLIER
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                out = run if out is None else out[: len(run) - have] * power + run[have:] if have else run
                have += size
            if have == k:
                return mixed(out[:n])
            run = run[:-size] * power + run[size:]
            size, power = 2 * size, power * power


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Ascending distinct values of the k-word shingles of a text with A-Z lowered; with fewer words the whole sequence is one."""
    h = word_hashes((text or "").encode().lower().split())
    if not len(h):
        return h
    return np.unique(rolling(h, min(k, len(h))))
