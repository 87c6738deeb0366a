from pyspark.sql import functions as F

from stratakv.functions.keys import bytewise_order
from stratakv.functions.lines import parse_line
from stratakv.operators import merge, policies
from stratakv.plans.compaction import compact
from stratakv.sources.workload import generate
from tests.test_policies import bottommost, frame, listed


def test_generated_logs(spark):
    df = generate(spark, 5, 400, seed=1)
    rows = [(bytes(r.user_key), r.seq, r.value_type, bytes(r.value), r.source_id) for r in df.collect()]
    assert sorted(rows) == sorted((bytes(r.user_key), r.seq, r.value_type, bytes(r.value), r.source_id) for r in generate(spark, 5, 400, seed=1).repartition(7).collect())
    assert len({r[0] for r in rows}) == 400 and {r[4] for r in rows} == set(range(5)) and {r[1] for r in rows} == {1, 2, 3}
    dead = sum(r[2] == 0 for r in rows)
    assert 20 <= dead <= 65 and listed(compact(df)) == bottommost(rows)
    assert generate(spark, 1, 0).count() == 0


def test_lines(spark):
    lines = ["a ==> b ==> c", "'k e' seq:7, type:1 => v", "'k' seq:1, type:0 => ", "nothing", "'x' seq:12345678901234567890, type:1 => v"]
    got = [r.e for r in spark.createDataFrame([(x,) for x in lines], "line string").select(parse_line(F.col("line")).alias("e")).collect()]
    assert (bytes(got[0].user_key), got[0].seq, bytes(got[0].value)) == (b"a", None, b"b ==> c")
    assert (bytes(got[1].user_key), got[1].seq, got[1].value_type, bytes(got[1].value)) == (b"k e", 7, 1, b"v")
    assert bytes(got[2].value) == b"" and got[2].value_type == 0 and got[3] is None and got[4].seq is None


def test_own_order(spark):
    rows = [(b"a", 1, 1, b"", 0), (b"a", 256, 1, b"", 0), (b"b", 1, 1, b"", 0)]
    assert [r[1] for r in listed(merge.in_order(frame(spark, rows), *bytewise_order()))] == [256, 1, 1]
    assert listed(merge.in_order(frame(spark, rows), F.col("user_key").desc(), F.col("seq")))[0][0] == b"b"
    assert policies.Passthrough().apply(frame(spark, rows)).count() == 3
