"""Wavelet matrix over token ids: bit planes with rank and select.

Ids are replaced by their place in the sorted list of ids that occur, and stored as one plane per bit of that
place, highest first; each plane puts the symbols whose bit is 0 before those whose bit is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RANK_BITS = 512


@dataclass
class WaveletMatrix:
    size: int
    alphabet: np.ndarray  # sorted ids, uint32
    planes: list[np.ndarray]  # packed bits, uint8
    zeros: list[int]
    ranks: list[np.ndarray]  # ones before each RANK_BITS bits, uint32

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        alphabet, symbols = _dense(ids)
        planes, zeros, ranks = [], [], []
        for bit in reversed(range(_width(len(alphabet)))):
            ones = (symbols & symbols.dtype.type(1 << bit)).astype(bool)
            planes.append(np.packbits(ones))
            ranks.append(_ranks(planes[-1]))
            low, high = symbols[~ones], symbols[ones]
            zeros.append(len(low))
            symbols = np.concatenate([low, high])
        return cls(len(ids), alphabet, planes, zeros, ranks)

    def tokens(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        symbols = np.zeros(self.size, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            ones = np.unpackbits(self.planes[level], count=self.size).view(bool)
            above = np.empty_like(symbols)
            above[~ones] = symbols[: self.zeros[level]]
            above[ones] = symbols[self.zeros[level] :] | symbols.dtype.type(1 << (len(self.planes) - 1 - level))
            symbols = above
        return self.alphabet[symbols] if self.size else np.zeros(0, np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // RANK_BITS
        rest = self.planes[level][block * RANK_BITS // 8 : -(-i // 8)]
        bits = np.unpackbits(rest, count=i - block * RANK_BITS) if i > block * RANK_BITS else rest[:0]
        return int(self.ranks[level][block]) + int(bits.sum()) if len(self.ranks[level]) > block else int(bits.sum())

    def access(self, i: int) -> int:
        symbol = 0
        for level in range(len(self.planes)):
            bit = self.planes[level][i // 8] >> (7 - i % 8) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            symbol = symbol * 2 + int(bit)
        return int(self.alphabet[symbol])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``token`` at places start to stop, exclusive."""
        low, high = self._range(token, start, self.size if stop is None else stop)
        return high - low

    def find(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of ``token``, from 0; -1 if there are fewer."""
        low, high = self._range(token, 0, self.size)
        if not 0 <= k < high - low:
            return -1
        i, symbol = low + k, int(np.searchsorted(self.alphabet, token))
        for level in reversed(range(len(self.planes))):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        symbol = int(np.searchsorted(self.alphabet, token))
        if symbol == len(self.alphabet) or self.alphabet[symbol] != token or stop <= start:
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, stop)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th such bit, by bisection over the rank blocks and a look into one."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * RANK_BITS - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        raw = self.planes[level][block * RANK_BITS // 8 : (block + 1) * RANK_BITS // 8]
        bits = np.unpackbits(raw)[: self.size - block * RANK_BITS]
        return block * RANK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])


def _width(symbols: int) -> int:
    return max(symbols - 1, 0).bit_length()


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
    place = np.cumsum(seen) - 1
    return alphabet, place.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)[ids]


def _ranks(plane: np.ndarray) -> np.ndarray:
    step = RANK_BITS // 8
    counts = np.bitwise_count(plane)
    starts = np.arange(0, len(plane), step)
    sums = np.add.reduceat(counts, starts, dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
    return (np.cumsum(sums) - sums).astype(np.uint32)
