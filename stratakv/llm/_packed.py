"""Columns of numbers packed into binary values, for shuffles of many small records.

A task's records for one range of keys travel as one row.  Sorted keys are kept
as differences, bytes of equal weight stand together, and zstd takes the rest.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard

_U = np.uint64


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """rising: the values never fall, so differences are kept."""
    v = values.astype(np.uint64)
    if rising and len(v):
        v = np.concatenate((v[:1], np.diff(v)))
    width = next((w for w in (1, 2, 4) if not len(v) or v.max() < _U(1) << _U(8 * w)), 8)
    planes = np.ascontiguousarray(v.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width, rising]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width, rising = data[0], data[1]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), np.uint8)
    v = np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(f"<u{width}").astype(np.uint64)
    return np.cumsum(v, dtype=np.uint64) if rising else v


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys, n+1 of them."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))


def give_back() -> None:
    """Returns memory that is no longer used to the system; a worker otherwise keeps what its largest range took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # a C library without it


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.int64).view(np.uint64)
