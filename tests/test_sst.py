import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratakv import cli
from stratakv.operators import merge, policies
from stratakv.plans import compaction
from stratakv.plans.compaction import compact_files, dump, read_sst, write_sst
from stratakv.sources.codec.errors import SstError
from stratakv.sources.codec.table import TableReader, WriteOptions, reader_of, write_table
from stratakv.sources.sst import decode_files
from tests.test_policies import bottommost, frame, listed, workload


def save(path, rows, **options):
    path.write_bytes(write_table(sorted((r[:4] for r in rows), key=lambda r: (r[0], -r[1], -r[2])), WriteOptions(**options)))
    return str(path)


@pytest.mark.parametrize("files", [1, 4])
def test_round_trip(spark, tmp_path, files):
    rows = workload(random.Random(3), 3, 300)
    write_sst(frame(spark, rows), str(tmp_path / "t"), files)
    assert sorted(listed(read_sst(spark, str(tmp_path / "t")))) == sorted(r[:4] for r in rows)
    names = sorted(os.listdir(tmp_path / "t"))
    assert 1 <= len(names) <= files and all(n.endswith(".sst") for n in names)


def test_options_and_empty_values(spark, tmp_path):
    rows = [(b"", 1, 1, b"", 0), (b"\xff\xfe", (1 << 56) - 1, 99, b"\x00" * 9000, 0)]
    for kind in ("NONE", "CRC32C", "XXH32", "XXH64", "XXH3"):
        path = str(tmp_path / kind)
        write_sst(frame(spark, rows), path, checksumType=kind, contextChecksum="0x42", columnFamily="", comparator="own")
        assert listed(merge.in_order(read_sst(spark, path))) == [r[:4] for r in rows]
        assert read_sst(spark, path, view="files").collect()[0].checksum_type == kind
        named = {r.name: r.text for r in read_sst(spark, path, view="properties").collect()}
        assert named["rocksdb.comparator"] == "own" and "rocksdb.column.family.name" not in named


def test_empty_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    write_sst(merge.empty(spark), path)
    assert read_sst(spark, path).count() == 0 and len(os.listdir(path)) == 1
    write_sst(frame(spark, [(b"a", 1, 1, b"x", 0)]), path, mode="overwrite")
    assert read_sst(spark, path).count() == 1 and len(os.listdir(path)) == 1


def test_append_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = workload(random.Random(9), 2, 100)
    for i in (0, 1):
        write_sst(frame(spark, [r for r in rows if r[4] == i]), path, mode="append")
    assert sorted(listed(read_sst(spark, path))) == sorted(r[:4] for r in rows)


def test_a_failed_job_leaves_the_files_there(spark, tmp_path):
    path = str(tmp_path / "t")
    write_sst(frame(spark, [(b"a", 1, 1, b"x", 0)]), path)
    repeated = frame(spark, [(b"a", 1, 1, b"y", 0), (b"a", 1, 1, b"z", 0)])
    for mode in ("overwrite", "append"):
        with pytest.raises(PySparkException):
            write_sst(repeated, path, mode=mode)
        assert listed(read_sst(spark, path)) == [(b"a", 1, 1, b"x")] and len(os.listdir(path)) == 1


def test_files_follow_the_bytes(spark, tmp_path):
    path = str(tmp_path / "t")
    write_sst(frame(spark, [(b"k%04d" % i, 1, 1, os.urandom(500), 0) for i in range(2000)]), path)
    assert read_sst(spark, path).count() == 2000


@pytest.mark.parametrize(("files", "kind"), [(1, "XXH3"), (2, "CRC32C"), (2, "NONE")])
def test_files_joined_of_ranges(spark, tmp_path, files, kind):
    """The frame's size is unknown, so there are as many ranges as shuffle partitions (4); a key's versions share a file."""
    path = str(tmp_path / "t")
    rows = [(b"k%03d" % (i // 9), 9 - i % 9, 1, b"v" * (i % 300), 0) for i in range(3000)]
    for mode in ("overwrite", "overwrite", "append"):
        write_sst(frame(spark, random.Random(1).sample(rows, 3000)), path, files, mode, checksumType=kind, contextChecksum=0x42, compression="zstd")
    names = sorted(os.listdir(path))
    assert len(names) == 2 * files and all(n.endswith(".sst") for n in names)
    assert sorted(listed(read_sst(spark, path))) == sorted([r[:4] for r in rows] * 2)
    for name in names:
        with open(f"{path}/{name}", "rb") as f:
            entries = [e[:4] for e in reader_of(f.read()).entries()]
        assert entries == sorted(entries, key=lambda e: (e[0], -e[1])) and {e[0] for e in entries}.isdisjoint(k for k, *_ in set(r[:4] for r in rows) - set(entries))
        named = {r.name: r.number for r in read_sst(spark, f"{path}/{name}", view="properties").collect()}
        assert (named["rocksdb.num.entries"], named["rocksdb.raw.value.size"]) == (len(entries), sum(len(e[3]) for e in entries))


@pytest.mark.parametrize("often", [200, 2500, 3000])
def test_versions_of_one_key_are_sorted_by_several_tasks(spark, tmp_path, monkeypatch, often):
    """sst_meta writes so: no range of its one file holds most entries where one key has most of them."""
    largest, by_ranges = [], compaction.by_ranges

    def counted(entries, parts=None):
        ranges = by_ranges(entries, parts)
        largest.append(max(r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()))
        return ranges

    monkeypatch.setattr(compaction, "by_ranges", counted)
    path = str(tmp_path / "t")
    rows = [(b"k5", 9000 - i, i % 2, b"v" * (i % 50), 0) for i in range(often)] + [(b"k%d" % (i % 10), i + 1, 1, b"w", 0) for i in range(3000 - often)]
    write_sst(frame(spark, random.Random(2).sample(rows, 3000)), path, 1)
    assert len(largest) == 1 and largest[0] < 1500
    (name,) = os.listdir(path)
    with open(f"{path}/{name}", "rb") as f:
        assert [e[:4] for e in reader_of(f.read()).entries()] == sorted((r[:4] for r in rows), key=lambda e: (e[0], -e[1]))


def test_repeated_entries_of_one_file_are_an_error(spark, tmp_path):
    """Also where ranges cut the versions of a key."""
    rows = [(b"k", 1 + i, 1, b"v", 0) for i in range(2000)]
    for more, options in (([(b"k", 1000, 1, b"w", 0)], {}), ([], {"forIngest": True})):
        with pytest.raises(PySparkException, match="does not follow"):
            write_sst(frame(spark, rows + more), str(tmp_path / "t"), 1, **options)
    assert not os.path.exists(tmp_path / "t") or os.listdir(tmp_path / "t") == []


def test_hidden_folders_are_no_input(spark, tmp_path):
    (tmp_path / ".ranges-1").mkdir()
    save(tmp_path / ".ranges-1" / "a.sst", [(b"a", 1, 1, b"x", 0)])
    save(tmp_path / "b.sst", [(b"b", 1, 1, b"y", 0)])
    assert listed(read_sst(spark, str(tmp_path))) == [(b"b", 1, 1, b"y")]


def test_few_reads():
    data = write_table([(b"k%06d" % i, 1, 1, b"v" * 100) for i in range(20000)])
    asked = []
    reader = TableReader(lambda offset, length: asked.append(length) or data[offset : offset + length], len(data))
    handles = [h for _, h in reader.index()]
    asked.clear()
    assert sum(1 for _ in reader.entries(handles)) == 20000
    assert len(handles) > 400 and len(asked) == 1
    asked.clear()
    assert len(list(reader.blocks(handles[:2] + handles[300:302]))) == 4 and len(asked) == 2


def test_compaction_of_files(spark, tmp_path):
    rows = workload(random.Random(5), 4, 200)
    inputs = [save(tmp_path / f"{i}.sst", [r for r in rows if r[4] == i]) for i in range(4)]
    compact_files(spark, inputs, str(tmp_path / "out"), files=3)
    assert sorted(listed(read_sst(spark, str(tmp_path / "out")))) == sorted(bottommost(rows))
    compact_files(spark, inputs, str(tmp_path / "in"), for_ingest=True)
    assert sorted(listed(read_sst(spark, str(tmp_path / "in")))) == sorted((r[0], 0, r[2], r[3]) for r in bottommost(rows))
    with pytest.raises(SstError):
        compact_files(spark, inputs, str(tmp_path / "no"), for_ingest=True, policy=policies.Passthrough())


def test_pruning_and_splitting(spark, tmp_path):
    rows = [(b"k%05d" % i, 1, 1, b"v" * 100, 0) for i in range(3000)]
    path = save(tmp_path / "a.sst", rows)
    whole = read_sst(spark, path, splitBytes=20_000, positions=True)
    assert whole.rdd.getNumPartitions() > 5 and whole.count() == 3000
    assert whole.select("block_no").distinct().count() == read_sst(spark, path, view="blocks").count()
    assert sorted(listed(read_sst(spark, path).where("user_key >= cast('k00100' as binary) and user_key < cast('k00110' as binary)"))) == [r[:4] for r in rows[100:110]]
    # A damaged block outside the range is not even read.
    data = bytearray((tmp_path / "a.sst").read_bytes())
    data[50] ^= 1
    (tmp_path / "b.sst").write_bytes(bytes(data))
    far = read_sst(spark, str(tmp_path / "b.sst"), userKeyFrom=b"k02000".hex(), userKeyTo=b"k02009".hex())
    assert far.count() == 10
    with pytest.raises(Exception, match="b.sst.*checksum"):
        read_sst(spark, str(tmp_path / "b.sst")).count()
    assert read_sst(spark, str(tmp_path / "b.sst"), verifyChecksums=False).count() > 0


def test_binary_files(spark, tmp_path):
    rows = workload(random.Random(9), 1, 50)
    save(tmp_path / "a.sst", rows)
    assert sorted(listed(decode_files(spark.read.format("binaryFile").load(str(tmp_path))))) == sorted(r[:4] for r in rows)


def test_bad_input(spark, tmp_path):
    (tmp_path / "short.sst").write_bytes(b"abc")
    with pytest.raises(Exception, match="footer"):
        read_sst(spark, str(tmp_path / "short.sst")).count()
    with pytest.raises(Exception, match="no such file"):
        read_sst(spark, str(tmp_path / "none.sst")).count()
    with pytest.raises(Exception, match="does not follow|one version"):
        write_sst(frame(spark, [(b"a", 1, 1, b"x", 0), (b"a", 2, 1, b"x", 0)]), str(tmp_path / "t"), forIngest=True)
    assert not os.path.exists(tmp_path / "t") or os.listdir(tmp_path / "t") == []
    with pytest.raises(Exception, match="unknown view"):
        read_sst(spark, str(tmp_path), view="nothing").count()


def test_commands(spark, tmp_path, capsys):
    a = save(tmp_path / "a.sst", [(b"k%02d" % i, 1, 1, b"v", 0) for i in range(25)])
    b = save(tmp_path / "b.sst", [(b"k03", 2, 0, b"", 0), (b"\xff", 1, 1, b"w", 0)])
    assert cli.run_dump(spark, b, True) == ["k03 ==> ", "� ==> w"]
    shown = cli.run_dump(spark, a, False)
    assert shown[-1] == "25 entries" and shown[-2].strip() == "... (5 more)" and "format version 7" in shown[0]
    (tmp_path / "list").write_text(f"{a}\n\n  {b}\n")
    assert cli.main(["compact", "--list", str(tmp_path / "list"), str(tmp_path / "out")]) == 0
    assert read_sst(spark, str(tmp_path / "out")).count() == 25
    assert cli.main(["compact", str(tmp_path / "out2")]) == 1
    assert "error" in capsys.readouterr().err
    assert dump(read_sst(spark, a)).count() == 25
