"""Vectorised word arrays over Arrow string columns.

A batch of texts is handled as one UTF-8 byte buffer.  Word boundaries and
64-bit word hashes come from a handful of numpy passes, so no Python code runs
per word.  Batches are cut into slices of bounded size, which bounds memory by
the slice or the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_U = np.uint64
_ROOT = _U(0x9E3779B97F4A7C15)
_MIX1 = _U(0xFF51AFD7ED558CCD)
_MIX2 = _U(0xC4CEB9FE1A85EC53)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _ROOT, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(4096)

#: Every byte but space and \t \n \v \f \r.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Letters and digits of ASCII and every byte of a longer code point.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

KEEP = np.arange(256, dtype=np.uint8)
LOWER = KEEP.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _MIX1
    x = x ^ (x >> _U(33))
    x = x * _MIX2
    return x ^ (x >> _U(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about ``limit`` bytes of text, one row at least."""
    _, at = text_buffer(batch.column(batch.schema.get_field_index(column)))
    row, rows = 0, batch.num_rows
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


@dataclass
class Words:
    """starts, ends: byte ranges of the words; bounds: of each text's words; hashes: 64 bits of each word."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(column: pa.Array, member: np.ndarray = NON_SPACE, fold: np.ndarray = LOWER, kinds: np.ndarray | None = None) -> Words:
    """Words are maximal runs of ``member`` bytes in one text; hashes are of the ``fold``-ed bytes.

    kinds: a number of 1 to 3 for each member byte; a word also ends where kind 1 meets kind 2.
    """
    data, at = text_buffer(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, at, none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    inside = member[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    if kinds is not None:
        kind = kinds[data]
        cut[1:n] |= kind[1:] * kind[:-1] == 2
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    bounds = np.searchsorted(starts, at)
    return Words(data, at, starts, ends, bounds, _hash_runs(fold[data[inside]], ends - starts))


def _hash_runs(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the runs that ``letters`` consists of."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    powers = _POW if longest <= len(_POW) else _powers(longest)
    return mix(np.add.reduceat(_BYTE[letters] * powers[place], first) ^ (lengths.astype(np.uint64) * _MIX2))


def hash_word(word: str, fold: np.ndarray = LOWER) -> int:
    """The hash that ``words`` gives a word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_hash_runs(fold[raw], np.array([len(raw)]))[0])


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one text each, and their bounds.

    A text with 1 to k-1 words gives one window, its whole sequence.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    n = len(hashes)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled *= _ROOT
            rolled += hashes[j : n - k + 1 + j]
        rows = np.flatnonzero(counts >= k)
        size = made[rows]
        base = np.repeat(bounds[rows], size)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(out_bounds[rows], size) + step] = mix(rolled[base + step])
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        value = np.array([counts[row]], np.uint64)
        for h in hashes[bounds[row] : bounds[row + 1]]:
            value = mix(value * _ROOT + h)
        out[out_bounds[row]] = value[0]
    return out, out_bounds


def char_starts(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte place, the end included."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
