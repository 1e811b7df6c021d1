"""Vectorised reading of text batches: bytes, words and rolling hashes over them.

Everything here works on one Arrow batch inside a task. Texts are taken in
chunks of about ``CHUNK_BYTES`` so that a task's arrays stay small; a longer
text forms a chunk of its own and needs some 60 bytes of memory per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_HALF = U64(32)

# Bases and byte values of the two polynomial hashes modulo 2**64, fixed so that every task and rerun agrees.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTE_VALUES = tuple(np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | U64(1) for seed in (11, 12))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        have = _powers[base] = (tables[0], tables[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit hash over the whole word."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xCA5A826395121157)
    h ^= h >> U64(32)
    return h


class Rolling:
    """Hash of any range of a sequence of 64-bit values in constant time, by prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self._forward, self._back = _power_tables(_BASES[which], len(values) + 1)
        self._sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self._forward[: len(values)], out=self._sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._back[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every run of ``k`` values, by its start."""
        n = max(0, len(self._sums) - k)
        return mix((self._sums[k:] - self._sums[:n]) * self._back[:n])


def byte_values(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTE_VALUES[which][data]


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A plain string array, null as empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``size`` bytes: (first row, end row, UTF-8 bytes, start of each row and the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        lo, hi = int(offsets[row]), int(offsets[end])
        yield row, end, data[lo:hi], offsets[row : end + 1] - lo
        row = end


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (space and tab to carriage return separate), and each row's first word.

    ``data`` is one chunk, ``bounds`` its row borders; a word never crosses a border.
    """
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    solid = ~blank[1:-1]
    first = solid & blank[:-2]
    last = solid & blank[2:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return data + ((data >= 65) & (data <= 90)) * np.uint8(32)


def concat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for every range one after another."""
    if len(start) == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest key in every window of ``width`` keys.

    Keys are compared by their high 32 bits, in chunks of any size alike; ties go to the left.
    """
    n = len(keys)
    if n < width:
        return np.zeros(0, np.int64)
    marked = (keys >> _HALF << _HALF) | np.arange(n, dtype=U64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(U64).max, U64)
    padded[:n] = marked
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & ((U64(1) << _HALF) - U64(1))).astype(np.int64)


def window_families(values: Rolling, bounds: np.ndarray, window: int, gram: int):
    """Group consecutive windows of a row that share their anchor.

    An anchor is the leftmost gram of ``gram`` values with the smallest hash in
    a window, so equal windows have the same anchor at the same place wherever
    they stand. Returns, per family: row, first window's start (in the chunk),
    number of windows, hash of the anchor gram, hash of all values the family covers.
    """
    grams = values.grams(gram)
    anchors = sliding_argmin(grams, window - gram + 1)
    lengths = np.diff(bounds)
    rows = np.flatnonzero(lengths >= window)
    starts = concat_ranges(bounds[rows], lengths[rows] - window + 1)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    at = anchors[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    row = np.searchsorted(bounds, begin, side="right") - 1
    return row, begin, count, grams[at[first]], values.ranges(begin, begin + count - 1 + window)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(U64, copy=False).view(np.int64)
