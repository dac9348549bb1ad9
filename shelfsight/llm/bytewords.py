"""Words and hashes of many texts at once, computed on the bytes of an Arrow text column.

Texts are handled in slices of bounded bytes; a text is never cut, so a slice holds at least one whole text.
Hashes are 64-bit polynomials over randomised byte values, mixed at the end; equal byte strings always have
equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants of a seed."""
    start = np.uint64(seed * 0xD1342543DE82EF95 & _MASK)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + start) | np.uint64(1)


_BYTES = constants(256, 1)
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
FOLDED = _BYTES[_LOWER]

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
#: digits, letters once lower-cased, and every byte of a character beyond ASCII
ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_a:_b] = True


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return Powers, (self.base,)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


POWERS = Powers(_BASE)
POWERS_2 = Powers(0xC2B2AE3D27D4EB4F)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in order, and the offset of each (one more than texts); nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts sum to about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffer(batch.column(batch.schema.get_field_index(name)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def word_bounds(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes within each text, and the first word of each text
    (one entry more than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    now = inside[1:-1]
    start = now & ~inside[:-2]
    end = now & ~inside[2:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = now[edges]
    end[edges - 1] = now[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def prefix_sums(data: np.ndarray, table: np.ndarray = _BYTES, powers: Powers = POWERS) -> np.ndarray:
    """Running polynomial of the bytes, for span_hashes."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers.get(len(data))
    np.cumsum(table[data] * up, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    _, down = powers.get(len(prefix))
    lengths = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + lengths * np.uint64(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, at: np.ndarray, member: np.ndarray, fold: bool):
    """Hash, start and end of each word, and each text's first word. ``fold`` lower-cases A-Z."""
    starts, ends, first = word_bounds(data, at, member)
    prefix = prefix_sums(data, FOLDED if fold else _BYTES)
    return span_hashes(prefix, starts, ends), starts, ends, first


def owners(first: np.ndarray) -> np.ndarray:
    """Number of the text that each element belongs to, from each text's first element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each (start, length), joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
