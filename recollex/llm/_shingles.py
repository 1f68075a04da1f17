"""Shingle hashes of whole texts, the same in every process and on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    get, h = known.get, xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        v = get(w)
        if v is None:
            v = known[w] = h(w)
        out.append(v)
    return np.array(out, dtype=np.uint64)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; of fewer words, of the whole run; of none, nothing."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w, n = word_hashes(words), min(size, len(words))
    count = len(words) - n + 1
    acc = np.full(count, np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = _mix(acc * _MUL + w[k : k + count])
    return np.unique(acc)
