"""The ``sst`` data source: table files as DataFrames, and DataFrames as table files.

Reading: ``spark.read.format("sst").load(path)`` after ``register(spark)``.
Options: ``view`` (entries, files, blocks, properties, meta), ``pathList`` (a
text file that names one input a line), ``verifyChecksums`` (true), ``mode``
(FAILFAST or DROPMALFORMED for internal keys under eight bytes), ``positions``
(true adds file_path, block_no and entry_no), ``splitBytes`` (large files are
read by several tasks, each a range of bytes; only they read the index), ``userKeyFrom`` and
``userKeyTo`` (hex, both inclusive).

Filters on user_key prune blocks by the index; Spark applies them again itself.

Writing: each partition becomes one file; rows must come in order, which
``write_sst`` in ``plans`` sees to and the writer checks.  Rows of one column
``tables``, lists of paths, make a file of the tables that they name, in that
order.  Files have temporary names until the job commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..schema import ENTRIES
from .codec.block import decode_entries
from .codec.checksum import Checksum
from .codec.compression import NAMES
from .codec.errors import SstError, SstFormatError
from .codec.table import SUFFIX, TableReader, TableWriter, WriteOptions, decode_property
from .files import PendingFile, discard, expand, opened, publish, remove, tables_in

BATCH_BYTES, BATCH_ROWS = 4_000_000, 16_384
SPLIT_BYTES = 128 << 20

_POSITIONS = [T.StructField("file_path", T.StringType()), T.StructField("block_no", T.IntegerType()), T.StructField("entry_no", T.IntegerType())]
_VIEWS = {
    "files": "file_path string, file_size long, magic string, format_version int, checksum_type string, metaindex_offset long, metaindex_size long, context_checksum long",
    "blocks": "file_path string, block_no int, offset long, size long, last_user_key binary, last_seq long, last_type int",
    "properties": "file_path string, name string, raw binary, number decimal(20,0), text string",
    "meta": "file_path string, name string, offset long, size long",
}


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


def entries_schema(positions: bool = False) -> T.StructType:
    return T.StructType([*ENTRIES.fields, *_POSITIONS]) if positions else ENTRIES


@dataclass
class FilePart(InputPartition):
    """The blocks of a file that begin at its bytes ``first`` to ``last``; all after first if last is None. source: the file's number."""

    path: str
    source: int
    first: int = 0
    last: int | None = None

    def __init__(self, path: str, source: int, first: int = 0, last: int | None = None) -> None:
        super().__init__(path)
        self.path, self.source, self.first, self.last = path, source, first, last


def split_keys(keys: list[bytes], drop_malformed: bool = False) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray | None]:
    """User keys, sequences and types of internal keys, and which were kept if some were not."""
    length = np.fromiter(map(len, keys), np.int64, len(keys))
    kept = None
    if len(length) and length.min() < SUFFIX:
        if not drop_malformed:
            raise SstFormatError(f"internal key of {length.min()} bytes")
        kept = length >= SUFFIX
        keys, length = [k for k in keys if len(k) >= SUFFIX], length[kept]
    data = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum(length)
    suffix = (ends - SUFFIX)[:, None] + np.arange(SUFFIX)
    packed = np.ascontiguousarray(data[suffix]).view("<u8").reshape(-1) if len(keys) else np.zeros(0, np.uint64)
    rest = np.ones(len(data), bool)
    rest[suffix.reshape(-1)] = False
    offsets = np.concatenate(([0], np.cumsum(length - SUFFIX))).astype(np.int32)
    user_key = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[rest]))])
    return user_key, pa.array((packed >> np.uint64(8)).astype(np.int64)), pa.array((packed & np.uint64(255)).astype(np.int32)), kept


class SstReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.options = options
        self.names = schema.names
        self.view = options.get("view", "entries")
        self.verify = _flag(options, "verifyChecksums", True)
        self.drop = options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.low = bytes.fromhex(options["userKeyFrom"]) if "userKeyFrom" in options else None
        self.high = bytes.fromhex(options["userKeyTo"]) if "userKeyTo" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("user_key",) and isinstance(f.value, (bytes, bytearray)):
                value = bytes(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = value if self.low is None else max(self.low, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = value if self.high is None else min(self.high, value)
            yield f  # bounds prune blocks; Spark keeps the exact test

    def _paths(self) -> list[tuple[str, int]]:
        paths = []
        if "pathList" in self.options:
            with opened(self.options["pathList"]) as (read_at, size):
                paths += [line.strip() for line in read_at(0, size).decode().splitlines() if line.strip()]
        if "paths" in self.options:
            import json

            paths += json.loads(self.options["paths"])
        elif "path" in self.options:
            paths.append(self.options["path"])
        return expand(paths)

    def partitions(self) -> list[FilePart]:
        parts = []
        for source, (path, size) in enumerate(self._paths()):
            if self.view != "entries" or size <= self.split:
                parts.append(FilePart(path, source))
                continue
            step = -(-size // -(-size // self.split))
            parts += [FilePart(path, source, first, first + step) for first in range(0, size, step)]
        return parts

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as (read_at, size):
            table = TableReader(read_at, size, part.path, self.verify)
            yield from self._entries(table, part) if self.view == "entries" else getattr(self, f"_{self.view}")(table, part.path, size)

    def _entries(self, table: TableReader, part: FilePart) -> Iterator[pa.RecordBatch]:
        chosen, before = [], None
        for b, (last, handle) in enumerate(table.index()):
            key = last[:-8]
            if handle.offset >= part.first and (part.last is None or handle.offset < part.last) and (self.low is None or key >= self.low) and (self.high is None or before is None or before <= self.high):
                chosen.append((b, handle))
            before = key
        keys: list[bytes] = []
        values: list[bytes] = []
        numbers, counts, size = [], [], 0
        for (b, _), block in zip(chosen, table.blocks([h for _, h in chosen]), strict=True):
            numbers.append(b), counts.append(decode_entries(block, keys, values))
            size += len(block)
            if len(keys) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self._batch(part, keys, values, numbers, counts)
                keys, values, numbers, counts, size = [], [], [], [], 0
        if keys:
            yield self._batch(part, keys, values, numbers, counts)

    def _batch(self, part: FilePart, keys: list[bytes], values: list[bytes], numbers: list[int], counts: list[int]) -> pa.RecordBatch:
        """Entries of blocks ``numbers``, which hold ``counts`` of them."""
        try:
            user_key, seq, kind, kept = split_keys(keys, self.drop)
        except SstFormatError as e:
            raise SstFormatError(f"{part.path}: {e}") from e
        if kept is not None:
            values = [v for v, k in zip(values, kept.tolist(), strict=True) if k]
        columns = [user_key, seq, kind, pa.array(values, pa.binary()), pa.array(np.full(len(user_key), part.source, np.int32))]
        if len(self.names) > len(columns):
            place = np.arange(sum(counts)) - np.repeat(np.cumsum(counts) - counts, counts)
            block = np.repeat(np.array(numbers, np.int32), counts)
            places = [pa.array((x if kept is None else x[kept]).astype(np.int32)) for x in (block, place)]
            columns += [pa.array([part.path] * len(user_key), pa.string()), *places]
        batch = pa.RecordBatch.from_arrays(columns, names=self.names)
        if self.low is not None:
            batch = batch.filter(pc.greater_equal(batch.column(0), pa.scalar(self.low, pa.binary())))
        if self.high is not None:
            batch = batch.filter(pc.less_equal(batch.column(0), pa.scalar(self.high, pa.binary())))
        return batch

    def _files(self, table: TableReader, path: str, size: int) -> Iterator[tuple]:
        f = table.footer
        yield path, size, "0x88e241b785f4cff7", f.version, f.checksum.name, f.metaindex.offset, f.metaindex.size, f.base

    def _blocks(self, table: TableReader, path: str, size: int) -> Iterator[tuple]:
        for b, (key, handle) in enumerate(table.index()):
            if len(key) < 8:
                raise SstFormatError(f"{path}: separator of {len(key)} bytes")
            packed = int.from_bytes(key[-8:], "little")
            yield path, b, handle.offset, handle.size, key[:-8], packed >> 8, packed & 255

    def _properties(self, table: TableReader, path: str, size: int) -> Iterator[tuple]:
        from decimal import Decimal

        for name, raw in table.properties().items():
            value = decode_property(name, raw)
            yield path, name, raw, Decimal(value) if isinstance(value, int) else None, value if isinstance(value, str) else None

    def _meta(self, table: TableReader, path: str, size: int) -> Iterator[tuple]:
        for name in table.meta:
            handle = table.meta_handle(name)
            yield path, name, handle.offset if handle else None, handle.size if handle else None


@dataclass
class Written(WriterCommitMessage):
    folder: str
    hidden: str
    name: str
    entries: int


def write_options(options: dict) -> WriteOptions:
    ingest = _flag(options, "forIngest", False)
    return WriteOptions(
        checksum=Checksum[options.get("checksumType", "XXH3").upper()],
        comparator=options.get("comparator", WriteOptions.comparator),
        column_family_id=int(options.get("columnFamilyId", 0)),
        column_family=options.get("columnFamily", WriteOptions.column_family),
        base=int(str(options.get("contextChecksum", 1)), 0),
        global_seqno=int(options.get("globalSeqno", 0)) if ingest else None,
        block_size=int(options.get("blockSize", 4096)),
        restart_interval=int(options.get("restartInterval", 16)),
        index_interval=int(options.get("indexInterval", 1)),
        compression={n.lower(): k for k, n in NAMES.items()}[options.get("compression", "none").lower()],
    )


class SstWriter(DataSourceArrowWriter):
    """One file a partition that has rows, and one empty file if no partition has.

    Names hold the job's number, so files that are there stay; an overwriting job removes them once its own have their names.
    """

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.joins = schema.names == ["tables"]
        missing = [] if self.joins else [n for n in ("user_key", "seq", "value_type", "value") if n not in schema.names]
        if missing:
            raise SstError(f"columns {missing} are missing")
        self.places = [] if self.joins else [schema.names.index(n) for n in ("user_key", "seq", "value_type", "value")]
        self.folder, self.overwrite, self.o = options["path"], overwrite, write_options(options)
        self.job = uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        file = PendingFile(self.folder, f"part-{context.partitionId() if context else 0:05d}-{self.job}.sst")
        try:
            writer = TableWriter(file.write, self.o)
            for batch in batches:
                for path in (p for tables in batch.column(0).to_pylist() for p in tables) if self.joins else ():
                    with opened(path) as (read_at, size):
                        writer.append(TableReader(read_at, size, path))
                for row in zip(*(batch.column(p).to_pylist() for p in self.places), strict=True):
                    if None in row:
                        raise SstFormatError(f"null in entry {row!r}")
                    writer.add(*row)
            writer.finish()
        except BaseException:
            discard(*file.close()[:2])
            raise
        return Written(*file.close(), writer.entries)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.name)
        old = tables_in(self.folder) if self.overwrite else []
        filled = [m for m in done if m.entries] or done[:1]
        for m in done:
            if m in filled:
                publish(m.folder, m.hidden, m.name)
            else:
                discard(m.folder, m.hidden)
        remove(old)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                discard(m.folder, m.hidden)


class SstDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sst"

    def schema(self) -> T.StructType | str:
        view = self.options.get("view", "entries")
        if view == "entries":
            return entries_schema(_flag(self.options, "positions", False))
        if view not in _VIEWS:
            raise SstError(f"unknown view {view}")
        return _VIEWS[view]

    def reader(self, schema: T.StructType) -> SstReader:
        return SstReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> SstWriter:
        return SstWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("sst")`` known, and lets Spark hand filters on to it (without that setting Spark refuses a reader that takes filters)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SstDataSource)


def decode_files(files, drop_malformed: bool = False, verify: bool = True):
    """Entries of whole files in a DataFrame of Spark's ``binaryFile`` source (path, content): for stores that only Spark reaches.

    A file is held in memory whole, so files should be of moderate size. source_id is null; file_path tells files apart.
    """
    from .codec.table import reader_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(k, s, t, v, path) for k, s, t, v, _, _ in reader_of(data, path, verify).entries(None, drop_malformed)]
                for lo in range(0, len(rows), BATCH_ROWS):
                    k, s, t, v, p = zip(*rows[lo : lo + BATCH_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(s, pa.int64()), pa.array(t, pa.int32()), pa.array(v, pa.binary()), pa.array(p)], ["user_key", "seq", "value_type", "value", "file_path"])

    return files.select("path", "content").mapInArrow(run, "user_key binary, seq long, value_type int, value binary, file_path string")


__all__ = ["SstDataSource", "decode_files", "register"]
