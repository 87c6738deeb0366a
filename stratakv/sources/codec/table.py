"""Whole files: writing sorted entries, and reading them by parts."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from . import footer as footers
from .block import TRAILER, BlockWriter, Handle, IndexWriter, decode_entries, read_entries, read_index, seal, unseal
from .checksum import Checksum, context
from .errors import SstFormatError, SstUnsupportedError
from .numbers import get_varint, put_varint

#: Names of meta blocks and of properties, with how their values are written.
PROPERTIES_BLOCK = "rocksdb.properties"
INDEX_BLOCK = "rocksdb.index"
BYTEWISE = "leveldb.BytewiseComparator"
PROPERTY_KINDS = {
    "rocksdb.block.based.table.index.type": "fixed32",
    "rocksdb.num.entries": "varint",
    "rocksdb.raw.key.size": "varint",
    "rocksdb.raw.value.size": "varint",
    "rocksdb.data.size": "varint",
    "rocksdb.index.size": "varint",
    "rocksdb.index.key.is.user.key": "varint",
    "rocksdb.index.value.is.delta.encoded": "varint",
    "rocksdb.comparator": "text",
    "rocksdb.column.family.id": "varint",
    "rocksdb.column.family.name": "text",
    "rocksdb.external_sst_file.version": "fixed32",
    "rocksdb.external_sst_file.global_seqno": "fixed64",
}

SUFFIX = 8
#: Neighbouring blocks are read together, up to so many bytes and over gaps of so many.
READ_BYTES, READ_GAP = 4 << 20, 64 << 10
EXTERNAL_VERSION = 2


def pack_key(user_key: bytes, seq: int, kind: int) -> bytes:
    return user_key + struct.pack("<Q", seq << 8 | kind)


def split_key(internal_key: bytes) -> tuple[bytes, int, int]:
    """(user key, sequence, type)."""
    if len(internal_key) < SUFFIX:
        raise SstFormatError(f"internal key of {len(internal_key)} bytes")
    packed = struct.unpack_from("<Q", internal_key, len(internal_key) - SUFFIX)[0]
    return internal_key[:-SUFFIX], packed >> 8, packed & 255


@dataclass(frozen=True)
class WriteOptions:
    """global_seqno: set for a file to be ingested, whose entries all get sequence 0."""

    checksum: Checksum = Checksum.XXH3
    comparator: str = BYTEWISE
    column_family_id: int = 0
    column_family: str = "default"
    base: int = 1
    global_seqno: int | None = None
    block_size: int = 4096
    restart_interval: int = 16
    index_interval: int = 1
    version: int = 7
    compression: int = 0


class TableWriter:
    """Writes entries, given in order, by ``write``; memory holds one block and the index."""

    def __init__(self, write: Callable[[bytes], object], options: WriteOptions = WriteOptions()) -> None:
        self.write, self.o = write, options
        self.offset = self.entries = self.key_bytes = self.value_bytes = self.data_bytes = 0
        self.block, self.index = BlockWriter(options.restart_interval), IndexWriter(options.index_interval)
        self.last: tuple[bytes, int, int] | None = None

    def add(self, user_key: bytes, seq: int, kind: int, value: bytes) -> None:
        if self.o.global_seqno is not None:
            seq = 0
        order = (user_key, -seq, -kind)
        if self.last is not None and order <= self.last:
            raise SstFormatError(f"entry {user_key!r} {seq} {kind} does not follow the last one" + (": a file to be ingested has one version of a key" if self.o.global_seqno is not None else ""))
        self.last = order
        key = pack_key(user_key, seq, kind)
        self.block.add(key, value)
        self.entries += 1
        self.key_bytes += len(key)
        self.value_bytes += len(value)
        if self.block.size() >= self.o.block_size:
            self._cut()

    def append(self, table: TableReader) -> None:
        """Adds a table of later entries, written with the same options but a base of 0: its blocks are copied, and their sums get what their new places add."""
        index = table.index()
        if not index:
            return
        if self.block.count:
            self._cut()
        handles = [h for _, h in index]
        first = next(table.entries(handles[:1]))
        if self.last is not None and (first[0], -first[1], -first[2]) <= self.last:
            raise SstFormatError(f"{table.name}: entry {first[0]!r} {first[1]} {first[2]} does not follow the last one")
        for lo, hi, data in table.runs(handles):
            sizes = np.array([h.size + TRAILER for h in handles[lo:hi]])
            ends = np.cumsum(sizes)
            if ends[-1] != len(data):
                raise SstFormatError(f"{table.name}: blocks from {handles[lo].offset} on have {len(data)} bytes instead of {ends[-1]}")
            moved = np.frombuffer(data, np.uint8).copy()
            places = (ends - 4)[:, None] + np.arange(4)
            added = np.array([context(self.o.base, self.offset + int(end - size)) for end, size in zip(ends, sizes, strict=True)], np.uint32)
            moved[places] = (np.ascontiguousarray(moved[places]).view("<u4").reshape(-1) + added).astype("<u4").view(np.uint8).reshape(-1, 4)
            self.write(moved.tobytes())
            for key, handle in index[lo:hi]:
                self.index.add_handle(key, Handle(self.offset, handle.size))
                self.offset += handle.size + TRAILER
            self.data_bytes += len(data)
        known = {k: decode_property(k, v) for k, v in table.properties().items()}
        self.entries += known["rocksdb.num.entries"]
        self.key_bytes += known["rocksdb.raw.key.size"]
        self.value_bytes += known["rocksdb.raw.value.size"]
        user_key, seq, kind = split_key(index[-1][0])
        self.last = (user_key, -seq, -kind)

    def _put(self, raw: bytes, compression: int = 0) -> Handle:
        stored = seal(raw, self.offset, self.o.checksum, self.o.base, compression)
        handle = Handle(self.offset, len(stored) - 5)
        self.write(stored)
        self.offset += len(stored)
        return handle

    def _cut(self) -> None:
        key = self.block.last
        handle = self._put(self.block.finish(), self.o.compression)
        self.data_bytes += handle.size + 5
        self.index.add_handle(key, handle)  # the block's last key, so that a search never passes it
        self.block = BlockWriter(self.o.restart_interval)

    def finish(self) -> None:
        if self.block.count:
            self._cut()
        index = self._put(self.index.finish())
        properties = self._put(self._properties(index.size))
        meta = BlockWriter(1)
        for name, handle in sorted(((INDEX_BLOCK, index), (PROPERTIES_BLOCK, properties))):
            meta.add(name.encode(), handle.encode())
        metaindex = self._put(meta.finish())
        self.write(footers.encode(self.o.version, self.o.checksum, metaindex, self.o.base, self.offset))

    def _properties(self, index_size: int) -> bytes:
        values: dict[str, int | str] = {
            "rocksdb.block.based.table.index.type": 0,
            "rocksdb.num.entries": self.entries,
            "rocksdb.raw.key.size": self.key_bytes,
            "rocksdb.raw.value.size": self.value_bytes,
            "rocksdb.data.size": self.data_bytes,
            "rocksdb.index.size": index_size,
            "rocksdb.index.key.is.user.key": 0,
            "rocksdb.index.value.is.delta.encoded": 1,
            "rocksdb.column.family.id": self.o.column_family_id,
        }
        if self.o.comparator:
            values["rocksdb.comparator"] = self.o.comparator
        if self.o.column_family:
            values["rocksdb.column.family.name"] = self.o.column_family
        if self.o.global_seqno is not None:
            values |= {"rocksdb.external_sst_file.version": EXTERNAL_VERSION, "rocksdb.external_sst_file.global_seqno": self.o.global_seqno}
        block = BlockWriter(1 << 62)
        for name in sorted(values):
            value, kind = values[name], PROPERTY_KINDS[name]
            block.add(name.encode(), value.encode() if kind == "text" else put_varint(value) if kind == "varint" else value.to_bytes(4 if kind == "fixed32" else 8, "little"))
        return block.finish()


def write_table(entries, options: WriteOptions = WriteOptions()) -> bytes:
    """A file's bytes from sorted (user key, seq, type, value)."""
    out = bytearray()
    writer = TableWriter(out.extend, options)
    for e in entries:
        writer.add(*e)
    writer.finish()
    return bytes(out)


class TableReader:
    """Reads a file of ``size`` bytes by ``read_at(offset, length)``; ``name`` goes into messages."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int, name: str = "", verify: bool = True) -> None:
        self.read_at, self.size, self.name, self.verify = read_at, size, name, verify
        with self._named():
            self.footer = footers.decode(read_at(max(0, size - footers.FOOTER), min(size, footers.FOOTER)), size)
            self.meta = {key.decode("utf-8", "replace"): value for key, value in read_entries(self.block(self.footer.metaindex))}

    def _named(self):
        return _Named(self.name)

    def block(self, handle: Handle) -> bytes:
        if handle.end > self.size:
            raise SstFormatError(f"block at {handle.offset} with {handle.size} bytes lies outside the file")
        return unseal(self.read_at(handle.offset, handle.size + 5), handle, self.footer.checksum, self.footer.base, self.verify)

    def meta_handle(self, name: str) -> Handle | None:
        """Where a meta block lies; None if there is none or its handle is no handle."""
        try:
            return Handle.decode(self.meta[name])[0]
        except (KeyError, SstFormatError):
            return None

    def properties(self) -> dict[str, bytes]:
        handle = self.meta_handle(PROPERTIES_BLOCK)
        with self._named():
            return {k.decode("utf-8", "replace"): v for k, v in read_entries(self.block(handle))} if handle else {}

    def index(self) -> list[tuple[bytes, Handle]]:
        """(last key, handle) of all data blocks."""
        with self._named():
            handle = self.footer.index or self.meta_handle(INDEX_BLOCK)
            if handle is None:
                raise SstFormatError("the metaindex names no index")
            known = {k: decode_property(k, v) for k, v in self.properties().items()}
            if known.get("rocksdb.block.based.table.index.type", 0) != 0:
                raise SstUnsupportedError("only plain binary-search indexes are supported")
            if known.get("rocksdb.index.key.is.user.key", 0):
                raise SstUnsupportedError("indexes of user keys are not supported")
            delta = known.get("rocksdb.index.value.is.delta.encoded", 0 if self.footer.version < 4 else 1)
            return list(read_index(self.block(handle), bool(delta)))

    def runs(self, handles: list[Handle]) -> Iterator[tuple[int, int, bytes]]:
        """(first, end, stored bytes) of blocks in file order that one read fetches."""
        with self._named():
            lo = 0
            while lo < len(handles):
                begin, hi = handles[lo].offset, lo + 1
                while hi < len(handles) and handles[hi - 1].end <= handles[hi].offset <= handles[hi - 1].end + READ_GAP and handles[hi].end - begin <= READ_BYTES:
                    hi += 1
                if handles[hi - 1].end > self.size:
                    raise SstFormatError(f"block at {handles[hi - 1].offset} with {handles[hi - 1].size} bytes lies outside the file")
                yield lo, hi, self.read_at(begin, handles[hi - 1].end - begin)
                lo = hi

    def blocks(self, handles: list[Handle]) -> Iterator[bytes]:
        """Contents of blocks in file order; one read fetches many."""
        with self._named():
            for lo, hi, data in self.runs(handles):
                begin = handles[lo].offset
                for h in handles[lo:hi]:
                    yield unseal(data[h.offset - begin : h.end - begin], h, self.footer.checksum, self.footer.base, self.verify)

    def entries(self, handles: list[Handle] | None = None, drop_malformed: bool = False) -> Iterator[tuple[bytes, int, int, bytes, int, int]]:
        """(user key, seq, type, value, block number, place in it) of all blocks, or of those given."""
        with self._named():
            for b, block in enumerate(self.blocks([h for _, h in self.index()] if handles is None else handles)):
                for e, (key, value) in enumerate(read_entries(block)):
                    if len(key) < SUFFIX and drop_malformed:
                        continue
                    yield (*split_key(key), value, b, e)


class _Named:
    """Puts the file's name before the message of a format error."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __enter__(self) -> None:
        pass

    def __exit__(self, kind, error, trace) -> None:
        from .errors import SstError

        if isinstance(error, SstError) and self.name and not str(error).startswith(self.name):
            raise type(error)(f"{self.name}: {error}") from error


def decode_property(name: str, value: bytes) -> int | str | None:
    """A property's value; None if its kind is unknown or it cannot be read."""
    kind = PROPERTY_KINDS.get(name)
    try:
        if kind == "varint":
            return get_varint(value, 0)[0]
    except SstFormatError:
        return None
    if kind in ("fixed32", "fixed64"):
        return int.from_bytes(value, "little")
    return value.decode("utf-8", "replace") if kind == "text" else None


def reader_of(data: bytes, name: str = "", verify: bool = True) -> TableReader:
    return TableReader(lambda offset, length: data[offset : offset + length], len(data), name, verify)
