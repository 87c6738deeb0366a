import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratakv.sources.codec import block, checksum, compression, footer, numbers, table
from stratakv.sources.codec.checksum import Checksum
from stratakv.sources.codec.errors import SstChecksumError, SstFormatError, SstUnsupportedError


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(value):
    data = numbers.put_varint(value)
    assert numbers.get_varint(data, 0) == (value, len(data))


@given(st.integers(-(2**62), 2**62))
def test_signed_round_trip(value):
    data = numbers.put_signed(value)
    assert numbers.get_signed(data, 0) == (value, len(data))


def test_varint_errors():
    with pytest.raises(SstFormatError):
        numbers.get_varint(b"\x80", 0)
    with pytest.raises(SstFormatError):
        numbers.get_varint(b"\xff" * 11, 0)
    with pytest.raises(SstFormatError):
        numbers.get_varint(numbers.put_varint(1 << 32), 0, 32)


def test_vectors():
    assert table.pack_key(b"apple", 1, 1).hex() == "6170706c65" + "0101000000000000"
    assert table.pack_key(b"banana", 5, 0).hex() == "62616e616e61" + "0005000000000000"
    assert table.pack_key(b"key", 10, 7).hex() == "6b6579" + "070a000000000000"
    w = block.BlockWriter(16)
    w.add(b"a", b"1")
    w.add(b"b", b"2")
    raw = w.finish()
    assert raw.hex() == "0001016131" + "0001016232" + "00000000" + "01000000"
    assert block.seal(raw, 0, Checksum.XXH3, 0)[len(raw) :].hex() == "00" + "ed362c5e"
    made = footer.encode(7, Checksum.XXH3, block.Handle(1000, 42), 0x12345678, 1047)
    assert made.hex() == "04" + "3e007a00" + "f2c7b1c2" + "78563412" + "2a000000" + "00" * 24 + "07000000" + "f7cff485b741e288"
    assert footer.decode(made, 1047 + 53) == footer.Footer(7, Checksum.XXH3, block.Handle(1000, 42), None, 0x12345678)
    assert checksum.crc32c(b"123456789") == 0xE3069283


def test_keys_at_the_edges():
    for key in ((b"", 0, 0), (b"\xff" * 3, (1 << 56) - 1, 255)):
        assert table.split_key(table.pack_key(*key)) == key
    with pytest.raises(SstFormatError):
        table.split_key(b"1234567")


@pytest.mark.parametrize("kind", list(Checksum))
@pytest.mark.parametrize("packed", [0, 1, 4, 5, 7])
def test_block_round_trip(kind, packed):
    w = block.BlockWriter(4)
    rows = [(b"key%04d" % i, b"value_%04d_payload" % i) for i in range(50)]
    for r in rows:
        w.add(*r)
    stored = block.seal(w.finish(), 12345, kind, 0xDEADBEEF, packed)
    handle = block.Handle(12345, len(stored) - 5)
    assert list(block.read_entries(block.unseal(stored, handle, kind, 0xDEADBEEF))) == rows
    flipped = bytes([stored[0] ^ 1]) + stored[1:]
    if kind is not Checksum.NONE:
        with pytest.raises(SstChecksumError):
            block.unseal(flipped, handle, kind, 0xDEADBEEF)
        with pytest.raises(SstChecksumError):
            block.unseal(stored, block.Handle(12346, handle.size), kind, 0xDEADBEEF)
    with pytest.raises(SstFormatError):
        block.unseal(stored[:-1], handle, kind, 0xDEADBEEF)


def test_compression_errors():
    for kind in (2, 3, 6, 99):
        with pytest.raises(SstUnsupportedError):
            compression.decompress(kind, b"abc")
    for kind in (1, 4, 7):
        with pytest.raises(SstFormatError):
            compression.decompress(kind, b"")
        with pytest.raises(SstFormatError):
            compression.decompress(kind, b"\x10garbage!")


@pytest.mark.parametrize("interval", [1, 3, 16])
def test_index_round_trip(interval):
    handles = [block.Handle(*h) for h in ((0, 100), (105, 110), (220, 90), (315, 130), (450, 50))]
    w = block.IndexWriter(interval)
    for i, h in enumerate(handles):
        w.add_handle(b"key%05d" % i, h)
    assert list(block.read_index(w.finish())) == [(b"key%05d" % i, h) for i, h in enumerate(handles)]


def test_bad_blocks():
    with pytest.raises(SstFormatError):
        list(block.read_entries(b"abc"))
    with pytest.raises(SstFormatError):
        list(block.read_entries(struct.pack("<I", 9)))
    end = struct.pack("<II", 0, 1)
    for entry in (b"\x05\x01\x00a", b"\x00\x7f\x00a", b"\x00\x01\x7fa", b"\x80"):
        with pytest.raises(SstFormatError):
            list(block.read_entries(entry + end))
    for entry in (b"\x05\x01a", b"\x00\x7fa", b"\x00\x01a\x80"):
        with pytest.raises(SstFormatError):
            list(block.read_index(entry + end))
    with pytest.raises(ValueError):
        block.BlockWriter(0)


def entries(n, size=20):
    return [(b"key%08d" % i, i + 1, 1, bytes([i % 251]) * size) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 500])
@pytest.mark.parametrize("kind", list(Checksum))
def test_table_round_trip(n, kind):
    rows = entries(n)
    data = table.write_table(rows, table.WriteOptions(checksum=kind))
    reader = table.reader_of(data)
    assert [e[:4] for e in reader.entries()] == rows
    known = {k: table.decode_property(k, v) for k, v in reader.properties().items()}
    assert known["rocksdb.num.entries"] == n
    assert known["rocksdb.raw.key.size"] == sum(len(r[0]) + 8 for r in rows)
    assert known["rocksdb.data.size"] == sum(h.size + 5 for _, h in reader.index())
    assert known["rocksdb.index.size"] == reader.meta_handle("rocksdb.index").size
    assert known["rocksdb.comparator"] == "leveldb.BytewiseComparator" and known["rocksdb.column.family.name"] == "default"
    assert "rocksdb.external_sst_file.version" not in known


def test_separators_are_last_keys():
    reader = table.reader_of(table.write_table(entries(2000, 512)))
    index = reader.index()
    assert len(index) > 100
    for separator, handle in index:
        keys = [k for k, _ in block.read_entries(reader.block(handle))]
        assert separator == keys[-1]
        assert handle.size >= 4096 or separator == index[-1][0]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.tuples(st.binary(max_size=6), st.integers(0, 2**56 - 1), st.sampled_from([0, 1, 2, 7, 15, 17, 99])), st.binary(max_size=40), max_size=60), st.integers(1, 5))
def test_random_tables(rows, interval):
    ordered = sorted(((k, s, t, v) for (k, s, t), v in rows.items()), key=lambda r: (r[0], -r[1], -r[2]))
    data = table.write_table(ordered, table.WriteOptions(restart_interval=interval, index_interval=interval, block_size=64))
    assert [e[:4] for e in table.reader_of(data).entries()] == ordered


def test_order_is_checked():
    with pytest.raises(SstFormatError):
        table.write_table([(b"b", 1, 1, b""), (b"a", 1, 1, b"")])
    with pytest.raises(SstFormatError):
        table.write_table([(b"a", 1, 1, b""), (b"a", 2, 1, b"")])
    with pytest.raises(SstFormatError):
        table.write_table([(b"a", 2, 1, b""), (b"a", 1, 1, b"")], table.WriteOptions(global_seqno=0))


def test_ingest_stamps():
    reader = table.reader_of(table.write_table(entries(3), table.WriteOptions(global_seqno=0)))
    assert [e[1] for e in reader.entries()] == [0, 0, 0]
    known = {k: table.decode_property(k, v) for k, v in reader.properties().items()}
    assert known["rocksdb.external_sst_file.version"] == 2 and known["rocksdb.external_sst_file.global_seqno"] == 0


def old_table(rows, version):
    """A file with a footer from before version 6: handles inside, no checksum over the footer."""
    out = bytearray()
    w, index = block.BlockWriter(), block.BlockWriter(1)
    for r in rows:
        w.add(table.pack_key(*r[:3]), r[3])

    def put(raw):
        stored = block.seal(raw, len(out), Checksum.CRC32C, 0)
        handle = block.Handle(len(out), len(stored) - 5)
        out.extend(stored)
        return handle

    index.add(w.last, put(w.finish()).encode())
    index_handle = put(index.finish())
    meta = put(block.BlockWriter(1).finish())
    out.extend((bytes([1]) + meta.encode() + index_handle.encode()).ljust(41, b"\0") + struct.pack("<IQ", version, footer.MAGIC))
    return bytes(out)


@pytest.mark.parametrize("version", [2, 3])
def test_old_footers(version):
    rows = entries(20)
    assert [e[:4] for e in table.reader_of(old_table(rows, version)).entries()] == rows


def test_bad_files():
    good = table.write_table(entries(10))
    for data, error in (
        (good[-30:], SstFormatError),
        (good[:-1] + b"\0", SstFormatError),
        (good[:-12] + struct.pack("<I", 8) + good[-8:], SstUnsupportedError),
        (good[:-12] + struct.pack("<I", 1) + good[-8:], SstUnsupportedError),
        (good[:-53] + b"\x09" + good[-52:], SstUnsupportedError),
        (good[:-52] + b"\0" + good[-51:], SstFormatError),
        (good[:-40] + b"\x01" + good[-39:], SstChecksumError),
        (good[:100] + good[101:], (SstFormatError, SstChecksumError)),
    ):
        with pytest.raises(error):
            list(table.reader_of(data, "some.sst").entries())
    with pytest.raises(SstUnsupportedError):
        footer.encode(5, Checksum.XXH3, block.Handle(0, 0), 0, 0)


def test_a_later_feature_is_refused():
    plain = footer.encode(7, Checksum.NONE, block.Handle(0, 5), 0, 10)
    with pytest.raises(SstUnsupportedError):
        footer.decode(plain[:33] + b"\1" + plain[34:], 63)


@pytest.mark.parametrize("kind", list(Checksum))
@pytest.mark.parametrize("packed", [0, 7])
def test_tables_joined(kind, packed):
    rows = [(b"k%05d" % (i // 3), 5 - i % 3, 1, b"v" * (i % 90)) for i in range(3000)]
    tables = [table.write_table(r, table.WriteOptions(kind, base=0, compression=packed)) for r in (rows[:1000], [], rows[1000:1001], rows[1001:])]
    out = bytearray()
    writer = table.TableWriter(out.extend, table.WriteOptions(kind, base=0x42424242, compression=packed))
    for data in tables:
        writer.append(table.reader_of(data))
    with pytest.raises(SstFormatError, match="does not follow"):
        writer.append(table.reader_of(tables[0]))
    writer.add(b"l", 1, 1, b"last")
    writer.finish()
    joined = table.reader_of(bytes(out))
    assert [e[:4] for e in joined.entries()] == [*rows, (b"l", 1, 1, b"last")]
    assert table.decode_property("rocksdb.num.entries", joined.properties()["rocksdb.num.entries"]) == 3001
    handles = [h for _, h in joined.index()]
    assert handles[0].offset == 0 and all(a.end == b.offset for a, b in zip(handles, handles[1:]))
