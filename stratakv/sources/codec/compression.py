"""Block compression. Blocks are written plain and read in the forms below."""

from __future__ import annotations

import pyarrow as pa

from .errors import SstError, SstFormatError, SstUnsupportedError
from .numbers import get_varint, put_varint

#: Compression types by their byte.
NAMES = {0: "None", 1: "Snappy", 2: "Zlib", 3: "BZip2", 4: "LZ4", 5: "LZ4HC", 6: "Xpress", 7: "Zstd"}
_CODECS = {1: "snappy", 4: "lz4_raw", 5: "lz4_raw", 7: "zstd"}


def decompress(kind: int, data: bytes) -> bytes:
    """Snappy tells its own size; LZ4 and Zstd have the size before the payload."""
    if kind == 0:
        return data
    if kind not in NAMES:
        raise SstUnsupportedError(f"unknown compression type {kind}")
    if kind not in _CODECS:
        raise SstUnsupportedError(f"compression {NAMES[kind]} is not supported")
    try:
        size, at = get_varint(data, 0)
    except SstFormatError:
        raise SstFormatError(f"{NAMES[kind]} block has no size") from None
    if size > 1 << 31:
        raise SstFormatError(f"{NAMES[kind]} block claims {size} bytes")
    try:
        return pa.Codec(_CODECS[kind]).decompress(data if kind == 1 else data[at:], size).to_pybytes()
    except (OSError, ValueError, pa.ArrowException) as e:
        raise SstFormatError(f"{NAMES[kind]} block cannot be decompressed: {e}") from e


def compress(kind: int, data: bytes) -> bytes:
    """The counterpart, for tests and for files of other writers."""
    if kind == 0:
        return data
    if kind not in _CODECS:
        raise SstError(f"cannot write compression {kind}")
    packed = pa.Codec(_CODECS[kind]).compress(data).to_pybytes()
    return packed if kind == 1 else put_varint(len(data)) + packed
