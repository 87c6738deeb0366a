"""Reads that versions allow, and statistics of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import internal_order, is_tombstone
from .policies import TIES, first_of


def as_of(entries: DataFrame, snapshot: int) -> DataFrame:
    """What a reader at the snapshot sees: each key's newest version up to it, unless that deletes the key."""
    return first_of(entries.where(F.col("seq") <= snapshot), F.col("user_key")).where(~is_tombstone())


def history(entries: DataFrame, user_key: bytes) -> DataFrame:
    """All versions of one key, newest first."""
    return entries.where(F.col("user_key") == F.lit(user_key)).orderBy(*internal_order())


def diff(entries: DataFrame, older: int, newer: int) -> DataFrame:
    """(user_key, change, old_value, new_value) between two snapshots, in one aggregate; change is added, removed or changed."""
    version = F.struct("value", "value_type", "seq")
    newest = F.struct(-F.col("seq"), -F.col("value_type"), *(c for c in TIES if c in entries.columns))
    seen = [F.min_by(version, F.when(F.col("seq") <= s, newest)) for s in (older, newer)]
    both = entries.where(F.col("seq") <= max(older, newer)).groupBy("user_key").agg(seen[0].alias("_old"), seen[1].alias("_new"))
    live = both.select("user_key", *(F.when(~is_tombstone(F.col(c)["value_type"]), F.col(c)).alias(c) for c in ("_old", "_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    differ = live.where(~F.col("_old.seq").eqNullSafe(F.col("_new.seq")))
    return differ.select("user_key", change.alias("change"), F.col("_old.value").alias("old_value"), F.col("_new.value").alias("new_value"))


def version_stats(entries: DataFrame) -> DataFrame:
    """One row for each key."""
    return entries.groupBy("user_key").agg(
        F.count("*").alias("versions"),
        F.sum(is_tombstone().cast("long")).alias("tombstones"),
        F.max("seq").alias("newest_seq"),
        F.min("seq").alias("oldest_seq"),
        F.sum(F.octet_length("value")).alias("value_bytes"),
    )


def run_stats(entries: DataFrame) -> DataFrame:
    """What the properties of a file with these entries would say: entries, raw key and value sizes."""
    return entries.agg(F.count("*").alias("entries"), F.sum(F.octet_length("user_key") + 8).alias("raw_key_size"), F.sum(F.octet_length("value")).alias("raw_value_size"))
