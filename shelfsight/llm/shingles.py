"""Distinct word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from shelfsight.llm.bytewords import NOT_SPACE, constants, mix, owners, word_hashes

WIDTH = 5


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and each text's first one.

    Words are runs without white space, A-Z lower-cased. A text of fewer than ``width`` words has its whole
    word sequence as its one shingle; one without words has none.
    """
    words, _, _, first = word_hashes(data, at, NOT_SPACE, fold=True)
    odd = constants(width + 1, 7)
    counts = np.diff(first)
    texts = len(counts)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    begins = np.zeros(texts + 1, np.int64)
    np.cumsum(n, out=begins[1:])
    hashes = np.empty(int(begins[-1]), np.uint64)

    if len(words) >= width:
        total = words[: len(words) - width + 1] * odd[0]
        for k in range(1, width):
            total = total + words[k : len(words) - width + 1 + k] * odd[k]
        who = owners(first)
        whole = who[: len(total)] == who[width - 1 :]
        hashes[np.repeat(counts >= width, n)] = mix(total[whole])
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[t] : first[t + 1]]
        hashes[begins[t]] = mix(np.sum(own * odd[: len(own)], keepdims=True) + odd[width:] * np.uint64(len(own)))[0]

    for t in np.flatnonzero(n > 1):
        hashes[begins[t] : begins[t + 1]].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begins[:-1][n > 0]] = True
    distinct = np.zeros(texts + 1, np.int64)
    np.cumsum(np.bincount(owners(begins)[new], minlength=texts), out=distinct[1:])
    return hashes[new], distinct


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Size of the intersection of the i-th set on the left with the i-th on the right."""
    (a, a_at), (b, b_at) = left, right
    out = np.zeros(len(a_at) - 1, np.int64)
    for i in range(len(out)):
        x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
        if len(x) and len(y):
            place = np.searchsorted(y, x)
            place[place == len(y)] = 0
            out[i] = np.count_nonzero(y[place] == x)
    return out
