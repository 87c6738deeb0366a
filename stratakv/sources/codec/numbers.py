"""Variable-length numbers: seven bits a byte, least significant first."""

from __future__ import annotations

from .errors import SstFormatError


def put_varint(value: int) -> bytes:
    if value < 0:
        raise ValueError(f"negative varint {value}")
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def get_varint(data: bytes, at: int, bits: int = 64) -> tuple[int, int]:
    """(value, place after it)."""
    value = shift = 0
    while True:
        if at >= len(data) or shift >= 64:
            raise SstFormatError(f"bad varint at byte {at}")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            break
        shift += 7
    if value >> bits:
        raise SstFormatError(f"varint {value} exceeds {bits} bits")
    return value, at


def put_signed(value: int) -> bytes:
    """Zigzag: small magnitudes of either sign become small numbers."""
    return put_varint((value << 1) ^ (value >> 63) if value >= 0 else ((-value) << 1) - 1)


def get_signed(data: bytes, at: int) -> tuple[int, int]:
    raw, at = get_varint(data, at)
    return (raw >> 1) ^ -(raw & 1), at
