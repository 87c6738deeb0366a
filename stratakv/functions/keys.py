"""Internal keys as column expressions.

An internal key is the user key followed by eight bytes, the little-endian
number ``seq * 256 + type``.  The packed number is unsigned, so it is never
held in a column; sequence and type are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TOMBSTONES, VALUE

SUFFIX = 8


def _swapped(hexed: Column, first_byte: int, count: int) -> Column:
    """The number whose little-endian bytes are written in hex from ``first_byte`` on."""
    parts = [F.substring(hexed, 2 * (first_byte + i) + 1, 2) for i in reversed(range(count))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def is_well_formed(internal_key: Column) -> Column:
    return F.length(internal_key) >= SUFFIX


def user_key(internal_key: Column) -> Column:
    return F.substring(internal_key, F.lit(1), F.length(internal_key) - SUFFIX)


def _suffix_hex(internal_key: Column) -> Column:
    return F.hex(F.substring(internal_key, F.length(internal_key) - (SUFFIX - 1), F.lit(SUFFIX)))


def value_type(internal_key: Column) -> Column:
    return _swapped(_suffix_hex(internal_key), 0, 1).cast("int")


def sequence(internal_key: Column) -> Column:
    return _swapped(_suffix_hex(internal_key), 1, 7)


def internal_key(user: Column, seq: Column, kind: Column) -> Column:
    """The bytes of an internal key."""
    big = F.concat(F.lpad(F.hex(seq), 14, "0"), F.lpad(F.hex(kind.cast("long")), 2, "0"))
    return F.concat(user, F.unhex(F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(SUFFIX))])))


def newest_first(ties: tuple[str, ...] = ()) -> list[Column]:
    """The order of versions of one user key: sequence, then type, falling. ties: further columns, rising."""
    return [F.col("seq").desc(), F.col("value_type").desc(), *(F.col(c).asc() for c in ties)]


def internal_order(ties: tuple[str, ...] = ()) -> list[Column]:
    """User key rising by unsigned bytes, versions newest first."""
    return [F.col("user_key").asc(), *newest_first(ties)]


def bytewise_order() -> list[Column]:
    """Plain byte order of the internal key."""
    return [internal_key(F.col("user_key"), F.col("seq"), F.col("value_type")).asc()]


def is_tombstone(kind: Column | None = None) -> Column:
    return (F.col("value_type") if kind is None else kind).isin(*TOMBSTONES)


def is_visible(kind: Column | None = None) -> Column:
    return (F.col("value_type") if kind is None else kind) == VALUE
