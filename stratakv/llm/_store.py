"""Tables that cut lineage, kept in the folder that driver and executors share; ids and names."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored

__all__ = ["id_remainder", "py_remainder", "stored", "table", "unused"]


def id_remainder(column: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def py_remainder(value: object, n: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % n


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that is no column of ``df``."""
    taken, k, made = {c.lower() for c in df.columns}, 0, name
    while made.lower() in taken:
        k += 1
        made = f"{name}_{k}"
    return made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
