"""Checksums of blocks and footers."""

from __future__ import annotations

from enum import IntEnum

import xxhash

from .errors import SstUnsupportedError

_LOW = 0xFFFFFFFF


class Checksum(IntEnum):
    NONE = 0
    CRC32C = 1
    XXH32 = 2
    XXH64 = 3
    XXH3 = 4


#: The multiplier that folds a last byte into XXH3, and the constant added by the CRC mask.
LAST_BYTE_FACTOR = 0x6B9083D9
MASK_DELTA = 0xA282EAD8


def _castagnoli() -> list[int]:
    """CRC of each byte, for the reflected polynomial 0x82F63B78."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _castagnoli()


def crc32c(data: bytes) -> int:
    crc = _LOW
    for byte in data:
        crc = _CRC[(crc ^ byte) & 255] ^ crc >> 8
    return crc ^ _LOW


def masked(crc: int) -> int:
    """Rotated right by 15 bits, plus a constant: data that holds CRCs stays well summed."""
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & _LOW


def kind_of(byte: int) -> Checksum:
    try:
        return Checksum(byte)
    except ValueError:
        raise SstUnsupportedError(f"unknown checksum type {byte}") from None


def checksum(kind: Checksum, data: bytes) -> int:
    """32 bits over all of ``data``; its last byte is the block's compression type, or the footer's end."""
    if kind is Checksum.NONE:
        return 0
    if kind is Checksum.CRC32C:
        return masked(crc32c(data))
    if kind is Checksum.XXH32:
        return xxhash.xxh32_intdigest(data)
    if kind is Checksum.XXH64:
        return xxhash.xxh64_intdigest(data) & _LOW
    if not data:
        return xxhash.xxh3_64_intdigest(data) & _LOW
    return (xxhash.xxh3_64_intdigest(data[:-1]) & _LOW) ^ (data[-1] * LAST_BYTE_FACTOR & _LOW)


def context(base: int, offset: int) -> int:
    """What a place in a file adds to a checksum, so that a block at a wrong place is noticed."""
    return base ^ ((offset + (offset >> 32)) & _LOW) if base else 0
