"""Keeping a compacted state up to date from a stream of changes.

Sequence numbers decide, not arrival, so late changes need no watermark: each
micro-batch is compacted with the state, and the policy keeps what is newest.

The state lies in buckets of the user key's hash.  A batch reads and writes the
buckets of its keys alone, as a version of each: ``of=<buckets>/batch=<number>/bucket=<k>``.
The newest version of every bucket makes up the state.  A batch that runs again
after a failure starts from the versions before it and writes the same; once a
batch is done, versions that neither it nor a repeat of it needs are removed, so
the folder holds two versions of a bucket at most.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.merge import merge
from ..operators.policies import Policy, SnapshotAware

#: Keeps the newest version of each key, deletions too: an older change may still arrive.
NEWEST = SnapshotAware(-1)
#: A bucket is read and written whole where a batch has one of its keys.
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_key"), F.lit(buckets)).cast("int")


def _system(spark: SparkSession, folder: str) -> tuple[JavaObject, JavaObject]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _number(path: JavaObject) -> int:
    return int(path.getName().partition("=")[2])


def _listed(system: JavaObject, path: JavaObject, name: str) -> list[JavaObject]:
    return [f.getPath() for f in system.listStatus(path) if f.getPath().getName().startswith(f"{name}=")] if system.exists(path) else []


def _root(spark: SparkSession, folder: str) -> JavaObject | None:
    """The folder of the state, whose name tells the number of buckets; None if there is none."""
    found = _listed(*_system(spark, folder), "of")
    if len(found) > 1:
        raise ValueError(f"{folder} has states of several numbers of buckets")
    return found[0] if found else None


def _versions(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """The batches that wrote each bucket, rising; batches that did not finish do not count."""
    root, out = _root(spark, folder), {}
    if root is None:
        return out
    system, _ = _system(spark, folder)
    for batch in sorted(_listed(system, root, "batch"), key=_number):
        if system.exists(spark._jvm.org.apache.hadoop.fs.Path(batch, "_SUCCESS")):
            for bucket in _listed(system, batch, "bucket"):
                out.setdefault(_number(bucket), []).append(_number(batch))
    return out


def _batch_path(folder: str, buckets: int, batch: int) -> str:
    return f"{folder}/of={buckets}/batch={batch:012d}"


def _remove_old(spark: SparkSession, folder: str, buckets: int, done: int) -> None:
    system, _ = _system(spark, folder)
    for bucket, batches in _versions(spark, folder).items():
        before = [n for n in batches if n < done]
        for n in before[:-1]:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{_batch_path(folder, buckets, n)}/bucket={bucket}"), True)


def upsert(changes: DataFrame, folder: str, policy: Policy = NEWEST, trigger: dict | None = None, checkpoint: str | None = None, buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer for a streaming DataFrame of entries; ``current`` reads the state.

    buckets: stays as it is for the life of a state.  A bucket should hold what a
    few tasks can write; its rows are dealt to files by their bytes.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = _root(spark, folder)
        if root is not None and _number(root) != buckets:
            raise ValueError(f"{folder} has a state of {_number(root)} buckets, not of {buckets}")
        touched = sorted(r.bucket for r in batch.select(_bucket(buckets).alias("bucket")).distinct().collect())  # at most so many numbers as there are buckets
        if not touched:
            return
        known = current(batch, folder, number, touched)
        rows = batch if known is None else merge(known, batch.select(*known.columns))
        kept = policy.apply(rows).withColumn("bucket", _bucket(buckets))
        kept.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(_batch_path(folder, buckets, number))
        _remove_old(spark, folder, buckets, number)

    writer = changes.writeStream.foreachBatch(apply).outputMode("update").trigger(**(trigger or {"availableNow": True}))
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer


def current(df: DataFrame, folder: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest state in the folder, of batches before ``before`` and of some buckets if given; None if there is none."""
    spark = df.sparkSession
    usable = {b: [n for n in found if before is None or n < before] for b, found in _versions(spark, folder).items() if buckets is None or b in buckets}
    paths = [f"{_batch_path(folder, _number(_root(spark, folder)), found[-1])}/bucket={b}" for b, found in sorted(usable.items()) if found]
    return spark.read.parquet(*paths) if paths else None
