"""Compaction policies: which versions of a key stay.

A policy takes entries and returns those it keeps, with their columns.  Ties of
sequence fall to the higher type; ties of both to the columns named in ``ties``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import is_tombstone, is_visible, newest_first

TIES = ("source_id", "value")


class Policy(Protocol):
    def apply(self, entries: DataFrame) -> DataFrame: ...


def _ties(entries: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in TIES if c in entries.columns)


def first_of(entries: DataFrame, *groups: Column) -> DataFrame:
    """The newest version in each group: a plain top-1, which Spark limits before the shuffle."""
    newest = F.row_number().over(Window.partitionBy(*groups).orderBy(*newest_first(_ties(entries))))
    return entries.withColumn("_rank", newest).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class Bottommost:
    """The newest version of each key, unless it deletes the key. Right only if nothing older lies beneath the output."""

    def apply(self, entries: DataFrame) -> DataFrame:
        return first_of(entries, F.col("user_key")).where(~is_tombstone())


@dataclass(frozen=True)
class SnapshotAware:
    """What is newest and what one snapshot sees: the first version of each key above the snapshot and the first at or below it, deletions too."""

    snapshot: int

    def apply(self, entries: DataFrame) -> DataFrame:
        return first_of(entries, F.col("user_key"), F.col("seq") <= self.snapshot)


@dataclass(frozen=True)
class Snapshots:
    """The same for any number of snapshots: the first version of each key between two neighbouring ones."""

    snapshots: tuple[int, ...]

    def apply(self, entries: DataFrame) -> DataFrame:
        seen_by = sum((F.when(F.col("seq") <= s, 1).otherwise(0) for s in sorted(set(self.snapshots))), F.lit(0))
        return first_of(entries, F.col("user_key"), seen_by)


@dataclass(frozen=True)
class Passthrough:
    """Everything stays."""

    def apply(self, entries: DataFrame) -> DataFrame:
        return entries


@dataclass(frozen=True)
class Where:
    """A policy of one's own as a condition over ``rank``, the version's place from 1 among those of its key."""

    keep: Callable[[Column], Column]

    def apply(self, entries: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("user_key").orderBy(*newest_first(_ties(entries))))
        return entries.withColumn("_rank", rank).where(self.keep(F.col("_rank"))).drop("_rank")


@dataclass(frozen=True)
class Stateful:
    """A policy that Python decides version by version, newest first: ``start`` makes an object with decide(seq, value_type, is_first).

    Versions stream through a task in order, a batch at a time, so memory does not
    follow the versions of a key; use a column policy where one can say it.
    """

    start: Callable[[], object]

    def apply(self, entries: DataFrame) -> DataFrame:
        start = self.start

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, state = object(), None
            for batch in batches:
                keep = []
                for k, seq, kind in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("user_key", "seq", "value_type")), strict=True):
                    is_first = k != key
                    if is_first:
                        key, state = k, start()
                    keep.append(bool(state.decide(seq, kind, is_first)))
                yield batch.filter(pa.array(keep, pa.bool_()))

        ordered = entries.repartition("user_key").sortWithinPartitions("user_key", *newest_first(_ties(entries)))
        return ordered.mapInArrow(decide, entries.schema)


def newest_by_aggregate(entries: DataFrame) -> DataFrame:
    """(user_key, value) of each key's newest version, unless it is a deletion: the same as Bottommost, by an aggregate."""
    newest = F.max_by(F.struct("value", "value_type"), F.struct("seq", "value_type"))
    return entries.groupBy("user_key").agg(newest.alias("_v")).where(~is_tombstone(F.col("_v.value_type"))).select("user_key", F.col("_v.value").alias("value"))


def tombstones(entries: DataFrame) -> DataFrame:
    return entries.where(is_tombstone())


def visible_values(entries: DataFrame) -> DataFrame:
    return entries.where(is_visible())
