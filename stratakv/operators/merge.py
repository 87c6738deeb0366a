"""Combining sorted runs, and cutting the key space into shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import internal_order
from ..schema import ENTRIES
from ..scratch import stored


def merge(*runs: DataFrame, number: bool = False) -> DataFrame:
    """All versions of all runs, none dropped. number: sets source_id to the run's place in the call."""
    if number:
        runs = tuple(r.withColumn("source_id", F.lit(i)) for i, r in enumerate(runs))
    return reduce(DataFrame.unionByName, runs)


def in_order(entries: DataFrame, *order: Column) -> DataFrame:
    """Sorted by internal key, across partitions; ties by source, then value.

    order: another order, as sort expressions; a comparator of one's own must be
    said as columns that sort alike.
    """
    if order:
        return entries.orderBy(*order)
    return entries.orderBy(*internal_order(tuple(c for c in ("source_id", "value") if c in entries.columns)))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENTRIES)


def source_sizes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_id").agg(F.count("*").alias("entries"))


def largest_source(entries: DataFrame) -> DataFrame:
    """The source with most entries, the last of those with as many."""
    return source_sizes(entries).orderBy(F.desc("entries"), F.desc("source_id")).limit(1)


def _largest(entries: DataFrame) -> DataFrame:
    return entries.join(F.broadcast(largest_source(entries).select("source_id")), "source_id", "left_semi")


def numbered(entries: DataFrame, *order: Column) -> DataFrame:
    """``entries`` with ``place``, their place from 0 in ``order`` (by default the internal order, then the value).

    Ranges of rows are numbered apart and offset by the counts of those before,
    so no task sees more than a range.  Ranges are stored first: a second pass
    of Spark's sampling could choose other bounds.
    """
    order = order or tuple(internal_order(("value",)))
    ranges = stored(entries.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_own", own).join(F.broadcast(offsets), "_range").withColumn("place", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def shard_boundaries(entries: DataFrame, shards: int) -> DataFrame:
    """(boundary_no, user_key): the keys at equal steps of the largest source, one less than shards; none without entries."""
    largest = numbered(_largest(entries))
    total = largest.agg(F.count("*").alias("n")).crossJoin(entries.sparkSession.range(1, max(1, shards)).select(F.col("id").alias("boundary_no")))
    wanted = total.where("n > 0").select("boundary_no", F.expr(f"boundary_no * n div {shards}").alias("place"))
    return largest.join(F.broadcast(wanted), "place").select("boundary_no", "user_key")


def lower_bound(entries: DataFrame, boundary: bytes) -> DataFrame:
    """(source_id, place): how many entries of each source have a smaller user key; versions of one key stay together."""
    return entries.groupBy("source_id").agg(F.sum(F.when(F.col("user_key") < F.lit(boundary), 1).otherwise(0)).alias("place"))


def with_shard(entries: DataFrame, boundaries: list[bytes]) -> DataFrame:
    """``entries`` with ``shard``, the number of boundaries at or below the user key."""
    return entries.withColumn("shard", sum((F.when(F.col("user_key") >= F.lit(b), 1).otherwise(0) for b in boundaries), F.lit(0)))
