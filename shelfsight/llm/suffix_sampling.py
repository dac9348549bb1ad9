"""Sampled suffixes: content-defined places such that equal windows are sampled at the same place.

A window of ``length`` bytes is owned by its least k-gram (by hash, the first of equal ones). Consecutive windows
with one owner form a run; equal windows have equal owners at equal distance, whatever surrounds them.
"""

from __future__ import annotations

import numpy as np

from shelfsight.llm.bytewords import POWERS_2, constants, prefix_sums, ragged_ranges, span_hashes

GRAM = 32
_PLACE = np.uint64((1 << 24) - 1)
_TABLE_2 = constants(256, 2)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by running minima of blocks from both ends."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def window_runs(data: np.ndarray, at: np.ndarray, length: int):
    """Runs of windows of each text: (text, first window's start in the text, windows, distance of the owner from
    it, owner's hash, hash of all bytes of the run). Texts below ``length`` have none. Up to 2**24 bytes."""
    sizes = np.diff(at)
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.any():
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    prefix = prefix_sums(data)
    ends = np.arange(GRAM, len(data) + 1)
    grams = span_hashes(prefix, ends - GRAM, ends)
    least = sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    starts = ragged_ranges(at[:-1][counts > 0], counts[counts > 0])
    owner = (least[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    run_start, n = starts[first], np.diff(np.concatenate([first, [len(starts)]]))
    text = np.searchsorted(at, run_start, "right") - 1
    block = spans_second(second_sums(data), run_start, run_start + n + length - 1)
    return text, run_start - at[text], n, owner[first] - run_start, grams[owner[first]], block


def second_sums(data: np.ndarray) -> np.ndarray:
    """As prefix_sums, for hashes independent of those."""
    return prefix_sums(data, _TABLE_2, POWERS_2)


def spans_second(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(sums, starts, ends, POWERS_2)
