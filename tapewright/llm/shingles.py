"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations


def word_hashes(text: bytes):
    """Hash of every word of the UTF-8 text; words are split at ASCII white space, A-Z in lower case."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h):
    """A bijection of 64-bit integers that spreads every bit."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, k: int):
    """Sorted distinct hashes of all runs of k words; of the whole sequence if it has fewer; empty without words."""
    import numpy as np

    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n])
    return np.unique(h)
