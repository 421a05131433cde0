"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle, an empty one none.

    Letters A-Z are lower-cased; words are what ASCII white space separates.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < width:
            total = np.asarray([n], np.uint64)
            for x in h:
                total = mix(total * U(0x9E3779B97F4A7C15) + x)
            return total
        total = h[: n - width + 1].copy()
        for j in range(1, width):
            total = mix(total) + h[j : n - width + 1 + j]
        return np.unique(mix(total))
