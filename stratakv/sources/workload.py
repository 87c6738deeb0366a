"""Random change logs of any size, made by expressions: the same for the same arguments, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DELETION, VALUE


def _draw(seed: int, what: str, *of: Column) -> Column:
    """A number from 0 to 999,999 for each value of ``of``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *of), F.lit(1_000_000))


def generate(spark: SparkSession, sources: int, keys: int, seed: int = 42, most_versions: int = 3, deleted: float = 0.1) -> DataFrame:
    """Each key has 1 to ``most_versions`` versions with falling sequences, each in a random source; the newest is a deletion with chance ``deleted``."""
    each = spark.range(keys).select(F.col("id").alias("k"), (_draw(seed, "versions", F.col("id")) % most_versions + 1).alias("n"))
    versions = each.select("k", "n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("seq"))
    newest = (F.col("seq") == F.col("n")) & (_draw(seed, "deleted", F.col("k")) < int(deleted * 1_000_000))
    return versions.select(
        F.concat(F.lit("key"), F.lpad(F.col("k").cast("string"), 9, "0")).cast("binary").alias("user_key"),
        F.col("seq").cast("long").alias("seq"),
        F.when(newest, DELETION).otherwise(VALUE).alias("value_type"),
        F.concat_ws("_", F.lit("value"), F.col("k").cast("string"), F.col("seq").cast("string")).cast("binary").alias("value"),
        (_draw(seed, "source", F.col("k"), F.col("seq")) % max(1, sources)).cast("int").alias("source_id"),
    )
