"""The last bytes of a file: where its metaindex is and how its blocks are summed."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from .block import TRAILER, Handle
from .checksum import Checksum, checksum, context, kind_of
from .errors import SstChecksumError, SstFormatError, SstUnsupportedError

#: Fixed values of the format.
MAGIC = 0x88E241B785F4CFF7
EXTENDED_MAGIC = bytes([0x3E, 0x00, 0x7A, 0x00])
FOOTER = 53
OLDEST, NEWEST = 2, 7

_TAIL = struct.Struct("<IQ")  # version and magic


@dataclass(frozen=True)
class Footer:
    version: int
    checksum: Checksum
    metaindex: Handle
    index: Handle | None = None  # before version 6
    base: int = 0  # of context checksums


def encode(version: int, kind: Checksum, metaindex: Handle, base: int, offset: int) -> bytes:
    """A footer of version 6 or later, to stand at ``offset``, right behind the metaindex block."""
    if version < 6:
        raise SstUnsupportedError(f"footers of version {version} are not written")
    if metaindex.size >> 32:
        raise SstFormatError("the metaindex is too large")

    def made(value: int) -> bytes:
        return bytes([kind]) + EXTENDED_MAGIC + struct.pack("<III", value, base, metaindex.size) + bytes(24) + _TAIL.pack(version, MAGIC)

    return made((checksum(kind, made(0)) + context(base, offset)) & 0xFFFFFFFF)


def decode(tail: bytes, file_size: int) -> Footer:
    """From the last FOOTER bytes of a file."""
    if len(tail) < FOOTER:
        raise SstFormatError(f"a file of {file_size} bytes has no room for a footer")
    tail = tail[-FOOTER:]
    version, magic = _TAIL.unpack_from(tail, FOOTER - _TAIL.size)
    if magic != MAGIC:
        raise SstFormatError(f"magic number {magic:#018x} is not that of a block-based table")
    if not OLDEST <= version <= NEWEST:
        raise SstUnsupportedError(f"format version {version} is not supported")
    kind = kind_of(tail[0])
    if version < 6:
        metaindex, at = Handle.decode(tail, 1)
        index, _ = Handle.decode(tail, at)
        return Footer(version, kind, metaindex, index)
    if tail[1:5] != EXTENDED_MAGIC:
        raise SstFormatError(f"extended magic {tail[1:5].hex()} is unknown")
    wanted, base, size = struct.unpack_from("<III", tail, 5)
    offset = file_size - FOOTER
    found = (checksum(kind, tail[:5] + bytes(4) + tail[9:]) + context(base, offset)) & 0xFFFFFFFF
    if kind is not Checksum.NONE and wanted != found:
        raise SstChecksumError(f"footer has checksum {found:#010x} instead of {wanted:#010x}")
    if any(tail[33:41]):
        raise SstUnsupportedError("the footer uses a feature of a later version")
    if offset - TRAILER - size < 0:
        raise SstFormatError("the metaindex lies before the file's start")
    return Footer(version, kind, Handle(offset - TRAILER - size, size), None, base)
