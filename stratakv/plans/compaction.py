"""Compaction jobs: merge runs, apply a policy, write the result."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import internal_order
from ..operators.merge import in_order, merge, shard_boundaries, with_shard
from ..operators.policies import Bottommost, Passthrough, Policy, Snapshots, SnapshotAware
from ..sources.codec.errors import SstError
from ..sources.files import expand, remove_folder
from ..sources.sst import register

#: Of entries to be written, as Spark estimates them: so many bytes are a range that one task sorts.
RANGE_BYTES = 8 << 20


def read_sst(spark: SparkSession, *paths: str, **options: object) -> DataFrame:
    """Entries (or another view) of table files and folders; source_id is the file's place."""
    register(spark)
    return spark.read.format("sst").options(**options).option("paths", json.dumps(paths)).load()


def compact(entries: DataFrame | Sequence[DataFrame], policy: Policy = Bottommost(), ordered: bool = True) -> DataFrame:
    """What the policy keeps of the runs, in internal order."""
    runs = [entries] if isinstance(entries, DataFrame) else list(entries)
    kept = policy.apply(merge(*runs, number=len(runs) > 1))
    return in_order(kept) if ordered else kept


def compact_sharded(entries: DataFrame, shards: int, policy: Policy = Bottommost(), exact: bool = False) -> DataFrame:
    """``compact`` split by ranges of user keys; each partition is a shard, in order, and all versions of a key share one.

    exact: boundaries are the keys at equal steps of the largest source, and a
    column ``shard`` tells the shard; else Spark samples boundaries.
    """
    kept = policy.apply(entries)
    if not exact:
        return by_keys(kept, max(1, shards))
    bounds = [bytes(r.user_key) for r in shard_boundaries(entries, shards).orderBy("boundary_no").collect()] if shards > 1 else []
    sharded = with_shard(kept, bounds)
    return sharded.repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", *internal_order())


def by_keys(entries: DataFrame, parts: int | None = None) -> DataFrame:
    """Partitions are disjoint, rising ranges of user keys, each in internal order; as many as Spark makes of the bytes if ``parts`` is None."""
    return entries.repartitionByRange(*([parts] if parts else []), "user_key").sortWithinPartitions(*internal_order())


def by_ranges(entries: DataFrame, parts: int) -> DataFrame:
    """Partitions are rising ranges in internal order; a key's versions may go on in the next one, so many versions of one key are sorted by several tasks."""
    return entries.repartitionByRange(parts, "user_key", F.col("seq").desc()).sortWithinPartitions(*internal_order())


def _ranges(entries: DataFrame, files: int, size: int | None) -> int:
    """Into how many ranges entries for ``files`` files are sorted: as their bytes ask for, or Spark's shuffle partitions at most."""
    if size is None:
        size = int(str(entries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(files, min(-(-size // RANGE_BYTES), int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _shared_out(tables: list[tuple[str, int]], files: int) -> list[list[str]]:
    """Neighbouring tables together, ``files`` groups of about equal bytes at most."""
    groups: dict[int, list[str]] = {}
    before, total = 0, sum(size for _, size in tables)
    for path, size in tables:
        groups.setdefault((2 * before + size) * files // (2 * total), []).append(path)
        before += size
    return list(groups.values())


def write_sst(entries: DataFrame, path: str, files: int | None = None, mode: str = "overwrite", size: int | None = None, **options: object) -> None:
    """Writes entries as ``files`` table files at most, with disjoint key ranges; without a number, files follow the bytes.

    A task sorts a range of moderate size, however few the files: many ranges
    are written as tables of their own, in a hidden folder of ``path``, and a task a
    file copies their blocks. Ranges of one file may cut a key's versions; else a task
    sorts all versions of a key. size: about how many bytes there are, if known better
    than by Spark. forIngest=True sets every sequence to 0; entries must then have one version
    of a key, which the writer checks.
    """
    register(entries.sparkSession)
    columns = entries.select("user_key", F.col("seq").cast("long"), F.col("value_type").cast("int"), "value")
    ranges = _ranges(columns, files, size) if files else None
    if ranges == files:
        by_keys(columns, files).write.format("sst").options(**options).mode(mode).save(path)
        return
    folder = f"{path.rstrip('/')}/.ranges-{uuid.uuid4().hex}"
    try:
        sorted_ranges = by_ranges(columns, ranges) if files == 1 else by_keys(columns, ranges)  # between two files no key may be cut
        sorted_ranges.write.format("sst").options(**(options | {"contextChecksum": 0})).mode("overwrite").save(folder)
        tables = sorted(expand([folder]), key=lambda t: (len(t[0]), t[0]))
        groups = entries.sparkSession.sparkContext.parallelize([(g,) for g in _shared_out(tables, files)], files)
        entries.sparkSession.createDataFrame(groups, "tables array<string>").write.format("sst").options(**options).mode(mode).save(path)
    finally:
        remove_folder(folder)


def compact_files(spark: SparkSession, inputs: Sequence[str], output: str, for_ingest: bool = False, policy: Policy = Bottommost(), files: int | None = None, **options: object) -> None:
    """The offline job: read table files, compact, write."""
    if for_ingest and isinstance(policy, (Passthrough, Snapshots, SnapshotAware)):
        raise SstError("a file to be ingested has one version of a key; this policy keeps more")
    kept = compact(read_sst(spark, *inputs), policy, ordered=False)
    stamps = {"forIngest": True, "globalSeqno": 0} if for_ingest else {}
    write_sst(kept, output, files, size=sum(size for _, size in expand(inputs)) if files else None, **({"contextChecksum": 0x42424242} | stamps | options))


def dump(entries: DataFrame) -> DataFrame:
    """One line for each entry, deletions too; bytes that are no UTF-8 are replaced."""
    lossy = [F.make_valid_utf8(F.col(c).cast("string")) for c in ("user_key", "value")]
    return entries.select(F.concat_ws(" ==> ", *lossy).alias("line"))
