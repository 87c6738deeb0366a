"""Blocks: sorted entries with shared key prefixes, and restart points where nothing is shared."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from .checksum import Checksum, checksum, context
from .compression import compress, decompress
from .errors import SstChecksumError, SstFormatError
from .numbers import get_signed, get_varint, put_signed, put_varint

TRAILER = 5  # one byte of compression type, four of checksum


@dataclass(frozen=True)
class Handle:
    """Where a block lies; its size leaves the trailer out."""

    offset: int
    size: int

    def encode(self) -> bytes:
        return put_varint(self.offset) + put_varint(self.size)

    @staticmethod
    def decode(data: bytes, at: int = 0) -> tuple[Handle, int]:
        offset, at = get_varint(data, at)
        size, at = get_varint(data, at)
        return Handle(offset, size), at

    @property
    def end(self) -> int:
        return self.offset + self.size + TRAILER


def seal(raw: bytes, offset: int, kind: Checksum, base: int, compression: int = 0) -> bytes:
    """A block's bytes as they stand at ``offset`` of a file."""
    body = compress(compression, raw) + bytes([compression])
    return body + struct.pack("<I", (checksum(kind, body) + context(base, offset)) & 0xFFFFFFFF)


def unseal(stored: bytes, handle: Handle, kind: Checksum, base: int, verify: bool = True) -> bytes:
    if len(stored) != handle.size + TRAILER:
        raise SstFormatError(f"block at {handle.offset} has {len(stored)} bytes instead of {handle.size + TRAILER}")
    body = stored[:-4]
    if verify and kind is not Checksum.NONE:
        wanted, found = struct.unpack("<I", stored[-4:])[0], (checksum(kind, body) + context(base, handle.offset)) & 0xFFFFFFFF
        if wanted != found:
            raise SstChecksumError(f"block at {handle.offset} has checksum {found:#010x} instead of {wanted:#010x}")
    return decompress(body[-1], body[:-1])


def entries_end(block: bytes) -> int:
    """Where the entries end and the restart points begin."""
    if len(block) < 4:
        raise SstFormatError(f"block of {len(block)} bytes has no restart count")
    end = len(block) - 4 - 4 * struct.unpack_from("<I", block, len(block) - 4)[0]
    if end < 0:
        raise SstFormatError("restart points exceed the block")
    return end


def decode_entries(block: bytes, keys: list[bytes], values: list[bytes]) -> int:
    """Appends the keys and values of a data block; gives their number."""
    end, at, key, before = entries_end(block), 0, b"", len(keys)
    add_key, add_value = keys.append, values.append
    while at < end:
        if at + 3 <= end and (shared := block[at]) < 128 and (fresh := block[at + 1]) < 128 and (size := block[at + 2]) < 128:
            at += 3  # the usual case: three numbers of one byte
        else:
            shared, at = get_varint(block, at, 32)
            fresh, at = get_varint(block, at, 32)
            size, at = get_varint(block, at, 32)
        middle = at + fresh
        stop = middle + size
        if shared > len(key):
            raise SstFormatError(f"entry shares {shared} bytes with a key of {len(key)}")
        if stop > end:
            raise SstFormatError("entry exceeds its block")
        key = key[:shared] + block[at:middle]
        add_key(key)
        add_value(block[middle:stop])
        at = stop
    return len(keys) - before


def read_entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Keys and values of a data block, in order."""
    keys: list[bytes] = []
    values: list[bytes] = []
    decode_entries(block, keys, values)
    return zip(keys, values, strict=True)


def read_index(block: bytes, delta: bool = True) -> Iterator[tuple[bytes, Handle]]:
    """Separators and handles of an index block. delta: handles may be written as a change of size after the last one."""
    if not delta:
        for key, value in read_entries(block):
            yield key, Handle.decode(value)[0]
        return
    end, at, key, last = entries_end(block), 0, b"", None
    restarts = {struct.unpack_from("<I", block, p)[0] for p in range(end, len(block) - 4, 4)}
    while at < end:
        begin = at
        shared, at = get_varint(block, at, 32)
        fresh, at = get_varint(block, at, 32)
        if shared > len(key):
            raise SstFormatError(f"index entry shares {shared} bytes with a key of {len(key)}")
        if at + fresh > end:
            raise SstFormatError("index entry exceeds its block")
        key = key[:shared] + block[at : at + fresh]
        at += fresh
        if shared and begin not in restarts:
            if last is None:
                raise SstFormatError("index entry changes a handle that is not there")
            change, at = get_signed(block, at)
            last = Handle(last.end, last.size + change)
        else:
            last, at = Handle.decode(block, at)
        if at > end or last.size < 0:
            raise SstFormatError("index entry has a bad handle")
        yield key, last


def shared_length(a: bytes, b: bytes) -> int:
    """How many leading bytes are equal."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7 >> 3)


class BlockWriter:
    """Collects sorted entries. interval: entries from one restart point to the next."""

    def __init__(self, interval: int = 16) -> None:
        if interval < 1:
            raise ValueError("the restart interval must be 1 at least")
        self.interval = interval
        self.body, self.restarts, self.since, self.last, self.count = bytearray(), [0], 0, b"", 0

    def _begin(self, key: bytes) -> tuple[int, bool]:
        """How many bytes the key shares with the last one; whether a restart point is here."""
        restart = self.since >= self.interval
        if restart:
            self.restarts.append(len(self.body))
            self.since = 0
        shared = 0 if restart else shared_length(self.last, key)
        self.since += 1
        self.count += 1
        self.last = key
        return shared, restart

    def add(self, key: bytes, value: bytes) -> None:
        shared, _ = self._begin(key)
        fresh, size = len(key) - shared, len(value)
        self.body += bytes((shared, fresh, size)) if shared < 128 and fresh < 128 and size < 128 else put_varint(shared) + put_varint(fresh) + put_varint(size)
        self.body += key[shared:]
        self.body += value

    def size(self) -> int:
        return len(self.body) + 4 * len(self.restarts) + 4

    def finish(self) -> bytes:
        return bytes(self.body) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))


class IndexWriter(BlockWriter):
    """Separators and handles of contiguous blocks."""

    def __init__(self, interval: int = 1) -> None:
        super().__init__(interval)
        self.handle: Handle | None = None

    def add_handle(self, key: bytes, handle: Handle) -> None:
        shared, _ = self._begin(key)
        self.body += put_varint(shared) + put_varint(len(key) - shared) + key[shared:]
        self.body += put_signed(handle.size - self.handle.size) if shared and self.handle else handle.encode()
        self.handle = handle
