import os
import random

import pytest
from pyspark.errors import StreamingQueryException

from stratakv.schema import ENTRIES
from stratakv.streaming.upsert import current, upsert
from tests.test_policies import frame, listed


def test_upsert(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    batches = [[(b"a", 5, 1, b"five", 0), (b"b", 1, 1, b"one", 0)], [(b"a", 3, 1, b"late", 0), (b"b", 2, 0, b"", 0), (b"c", 9, 1, b"c", 0)]]
    assert current(spark.range(1), state) is None
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        changes = spark.readStream.schema(ENTRIES).parquet(source)
        upsert(changes, state, checkpoint=str(tmp_path / "check")).start().awaitTermination()
    assert sorted(listed(current(spark.range(1), state))) == [(b"a", 5, 1, b"five"), (b"b", 2, 0, b""), (b"c", 9, 1, b"c")]


def run(spark, tmp_path, rows, buckets=8):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema(ENTRIES).parquet(str(tmp_path / "in"))
    upsert(changes, str(tmp_path / "state"), checkpoint=str(tmp_path / "check"), buckets=buckets).start().awaitTermination()


def versions(tmp_path):
    """Batches by bucket, as the folder has them."""
    out = {}
    for path in (tmp_path / "state").glob("of=*/batch=*/bucket=*"):
        out.setdefault(path.name, []).append(path.parent.name)
    return out


def test_batches_write_their_buckets_alone(spark, tmp_path):
    rng = random.Random(3)
    newest, rows = {}, 0
    for batch in range(5):
        own = [(b"k%02d" % rng.randint(0, 40), 1000 * rng.randint(1, 9) + rows + i, 1, b"v%d" % rng.randint(0, 99), 0) for i in range(40 if batch == 0 else 3)]
        rows += len(own)
        for r in own:
            newest[r[0]] = max(newest.get(r[0], r), r, key=lambda x: x[1])
        run(spark, tmp_path, own)
        assert sorted(listed(current(spark.range(1), str(tmp_path / "state")))) == sorted(r[:4] for r in newest.values())
        found = versions(tmp_path)
        assert all(len(x) <= 2 for x in found.values())
        assert sum(f"batch={batch:012d}" in x for x in found.values()) <= len({r[0] for r in own})


def test_a_batch_that_runs_again(spark, tmp_path):
    """The last batch again, from the versions before it: its commit is taken back."""
    for rows in ([(b"a", 1, 1, b"x", 0), (b"b", 1, 1, b"x", 0)], [(b"a", 2, 1, b"y", 0)], [(b"a", 3, 1, b"z", 0)]):
        run(spark, tmp_path, rows)
    before = sorted(listed(current(spark.range(1), str(tmp_path / "state"))))
    for name in ("2", ".2.crc"):
        if (tmp_path / "check" / "commits" / name).exists():
            os.remove(tmp_path / "check" / "commits" / name)
    run(spark, tmp_path, [(b"c", 1, 1, b"w", 0)])
    assert before == [(b"a", 3, 1, b"z"), (b"b", 1, 1, b"x")]
    assert sorted(listed(current(spark.range(1), str(tmp_path / "state")))) == [*before, (b"c", 1, 1, b"w")]


def test_buckets_stay(spark, tmp_path):
    run(spark, tmp_path, [(b"a", 1, 1, b"x", 0)])
    with pytest.raises(StreamingQueryException, match="8 buckets, not of 4"):
        run(spark, tmp_path, [(b"a", 2, 1, b"x", 0)], buckets=4)
