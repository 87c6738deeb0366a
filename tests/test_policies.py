import random

import pytest

from stratakv.functions import keys
from stratakv.operators import history, merge, policies
from stratakv.plans.compaction import compact, compact_sharded
from stratakv.queries import AtSnapshot
from stratakv.schema import ENTRIES

from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame([(k, s, t, v, src) for k, s, t, v, src in rows], ENTRIES)


def listed(df):
    return [(bytes(r.user_key), r.seq, r.value_type, bytes(r.value)) for r in df.collect()]


def versions(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], -r[1], -r[2], r[4], r[3])):
        out.setdefault(r[0], []).append(r[:4])
    return out


def bottommost(rows):
    return [v[0] for v in versions(rows).values() if v[0][2] not in (0, 7)]


def snapshot(rows, s):
    out = []
    for v in versions(rows).values():
        seen = False
        for i, r in enumerate(v):
            fits = r[1] <= s and not seen
            seen |= fits
            if i == 0 or fits:
                out.append(r)
    return out


def workload(rng, sources, n, ties=False):
    rows = []
    for i in range(n):
        count = rng.randint(1, 4)
        for v in range(count):
            seq = rng.randint(0, 3) if ties else count - v
            kind = rng.choice([0, 1, 2, 7, 15, 17, 99]) if ties else (0 if v == 0 and rng.random() < 0.1 else 1)
            rows.append((b"key%06d" % i, seq, kind, b"value_%d_%d" % (i, rng.randint(0, 9)), rng.randrange(sources)))
    return rows


def test_golden_bottommost(spark):
    rows = [(b"apple", 1, 1, b"old_apple", 0), (b"banana", 1, 1, b"old_banana", 0), (b"cherry", 1, 1, b"only_cherry", 0), (b"apple", 5, 1, b"new_apple", 1), (b"banana", 5, 0, b"", 1)]
    assert listed(compact(frame(spark, rows))) == [(b"apple", 5, 1, b"new_apple"), (b"cherry", 1, 1, b"only_cherry")]


def test_golden_snapshots(spark):
    rows = [(b"key", 10, 1, b"current_value", 0), (b"key", 4, 0, b"", 0), (b"key", 2, 1, b"ancient_value", 0)]
    kept = compact(frame(spark, rows), policies.SnapshotAware(5))
    assert [r[1] for r in listed(kept)] == [10, 4]
    assert [r[3] for r in listed(policies.visible_values(kept))] == [b"current_value"]
    four = [(b"a", s, 1, b"v", 0) for s in (10, 7, 4, 2)]
    assert [r[1] for r in listed(compact(frame(spark, four), policies.SnapshotAware(5)))] == [10, 4]
    assert [r[1] for r in listed(compact(frame(spark, [(b"a", 5, 1, b"", 0), (b"a", 3, 1, b"", 0)]), policies.SnapshotAware(100)))] == [5]


def test_golden_passthrough_and_tombstone(spark):
    rows = [(b"k", 3, 1, b"v3", 0), (b"k", 2, 1, b"v2", 0), (b"k", 1, 0, b"", 0)]
    assert len(listed(compact(frame(spark, rows), policies.Passthrough()))) == 3
    one = frame(spark, [(b"b", 5, 0, b"", 0)])
    assert listed(compact(one)) == [] and len(listed(compact(one, policies.Passthrough()))) == 1


def test_order(spark):
    rows = [(b"key", 5, 1, b"", 0), (b"key", 10, 1, b"", 0), (b"bbb", 1, 1, b"", 0), (b"aaa", 5, 1, b"", 0), (b"t", 4, 1, b"", 0), (b"t", 4, 7, b"", 0), (b"\x80", 1, 1, b"", 0), (b"", 1, 1, b"", 0), (b"aa", 9, 1, b"", 0)]
    assert [r[:3] for r in listed(merge.in_order(frame(spark, rows)))] == [(b"", 1, 1), (b"aa", 9, 1), (b"aaa", 5, 1), (b"bbb", 1, 1), (b"key", 10, 1), (b"key", 5, 1), (b"t", 4, 7), (b"t", 4, 1), (b"\x80", 1, 1)]


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_policies(spark, seed, ties):
    rng = random.Random(seed)
    rows = workload(rng, rng.randint(1, 12), 150, ties)
    df = frame(spark, rows).cache()
    assert listed(compact(df)) == bottommost(rows)
    for s in (0, 1, 2, 100):
        assert sorted(listed(compact(df, policies.SnapshotAware(s)))) == sorted(snapshot(rows, s))
    if not ties:
        newest = {bytes(r.user_key): bytes(r.value) for r in policies.newest_by_aggregate(df).collect()}
        assert newest == {r[0]: r[3] for r in bottommost(rows)}
    start = lambda: AtSnapshot(1)
    assert sorted(listed(policies.Stateful(start).apply(df))) == sorted(snapshot(rows, 1))
    df.unpersist()


def test_stateful_over_many_batches(spark):
    """A key whose versions fill many Arrow batches."""
    rows = [(b"hot", s, 1, b"", 0) for s in range(1, 2001)] + [(b"k%03d" % i, 1, 1, b"", 0) for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = listed(policies.Stateful(lambda: AtSnapshot(700)).apply(frame(spark, rows)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(snapshot(rows, 700))


def test_diff_equals_two_reads(spark):
    rows = workload(random.Random(7), 12, 150, True)
    df = frame(spark, rows).cache()
    for older, newer in ((0, 3), (2, 9), (5, 5), (9, 2)):
        old, new = ({r[0]: r for r in listed(history.as_of(df, s))} for s in (older, newer))
        want = sorted((k, old.get(k, (None,) * 4)[3], new.get(k, (None,) * 4)[3]) for k in old.keys() | new.keys() if old.get(k, (None, None))[1] != new.get(k, (None, None))[1])
        got = [(bytes(r.user_key), r.old_value and bytes(r.old_value), r.new_value and bytes(r.new_value)) for r in history.diff(df, older, newer).collect()]
        assert sorted(got, key=str) == sorted(((k, o and bytes(o), n and bytes(n)) for k, o, n in want), key=str)
    df.unpersist()


def test_many_snapshots(spark):
    rows = [(b"a", s, 1, b"", 0) for s in range(1, 10)]
    assert [r[1] for r in listed(compact(frame(spark, rows), policies.Snapshots((3, 6))))] == [9, 6, 3]


@pytest.mark.parametrize("shards", [1, 2, 3, 4, 7])
def test_shards_do_not_change_the_result(spark, shards):
    rows = workload(random.Random(shards), 5, 200)
    df = frame(spark, rows)
    for exact in (False, True):
        kept = compact_sharded(df, shards, exact=exact)
        parts = kept.withColumn("p", F.spark_partition_id()).collect()
        assert sorted((bytes(r.user_key), r.seq, r.value_type, bytes(r.value)) for r in parts) == sorted(bottommost(rows))
        spans = {}
        for r in parts:
            spans.setdefault(r.p, []).append(bytes(r.user_key))
        ordered = [spans[p] for p in sorted(spans)]
        assert all(s == sorted(s) for s in ordered)
        assert all(a[-1] < b[0] for a, b in zip(ordered, ordered[1:]))


def test_few_keys_many_shards(spark):
    assert len(listed(compact_sharded(frame(spark, [(b"a", 1, 1, b"x", 0)]), 5, exact=True))) == 1
    assert listed(compact_sharded(merge.empty(spark), 3, exact=True)) == []


def test_runs_keep_all_versions(spark):
    a, b = frame(spark, [(b"k", 5, 1, b"new", 0)]), frame(spark, [(b"k", 2, 1, b"old", 0)])
    assert [r[3] for r in listed(merge.in_order(merge.merge(b, a, number=True)))] == [b"new", b"old"]
    assert listed(merge.in_order(merge.merge(merge.empty(spark), merge.empty(spark)))) == []


def test_identical_keys_in_two_sources(spark):
    rows = [(b"k", 5, 1, b"second", 1), (b"k", 5, 1, b"first", 0)]
    assert listed(compact(frame(spark, rows))) == [(b"k", 5, 1, b"first")]


def test_boundaries_and_bounds(spark):
    rows = [(b"k%03d" % i, 1, 1, b"", 0) for i in range(8)] + [(b"a", 1, 1, b"", 1)]
    df = frame(spark, rows)
    assert [bytes(r.user_key) for r in merge.shard_boundaries(df, 4).orderBy("boundary_no").collect()] == [b"k002", b"k004", b"k006"]
    assert {r.source_id: r.place for r in merge.lower_bound(df, b"k003").collect()} == {0: 3, 1: 1}
    tie = frame(spark, [(b"a", 1, 1, b"", 0), (b"b", 1, 1, b"", 3)])
    assert merge.largest_source(tie).collect()[0].source_id == 3


def test_reads(spark):
    rows = [(b"a", 1, 1, b"x", 0), (b"a", 5, 0, b"", 0), (b"b", 2, 1, b"y", 0), (b"b", 6, 1, b"z", 0), (b"c", 7, 1, b"n", 0)]
    df = frame(spark, rows)
    assert sorted(listed(history.as_of(df, 4))) == [(b"a", 1, 1, b"x"), (b"b", 2, 1, b"y")]
    assert {(bytes(r.user_key), r.change) for r in history.diff(df, 4, 9).collect()} == {(b"a", "removed"), (b"b", "changed"), (b"c", "added")}
    assert [r[1] for r in listed(history.history(df, b"b"))] == [6, 2]


def test_internal_key_columns(spark):
    rows = [(b"", 0, 0, b"", 0), (b"\xff\x00", (1 << 56) - 1, 255, b"", 0), (b"key", 300, 7, b"", 0)]
    k = keys.internal_key(F.col("user_key"), F.col("seq"), F.col("value_type"))
    got = frame(spark, rows).select(k.alias("k")).select("k", keys.user_key(F.col("k")).alias("u"), keys.sequence(F.col("k")).alias("s"), keys.value_type(F.col("k")).alias("t")).collect()
    assert [(bytes(r.u), r.s, r.t) for r in got] == [r[:3] for r in rows]
    from stratakv.sources.codec.table import pack_key

    assert [bytes(r.k) for r in got] == [pack_key(*r[:3]) for r in rows]


def test_plan_limits_before_the_shuffle(spark):
    plan = policies.Bottommost().apply(frame(spark, [(b"a", 1, 1, b"", 0)]))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
