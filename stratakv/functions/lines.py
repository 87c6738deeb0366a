"""Entries from lines of text dumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"(?s)^(.*?) ==> (.*)$"
_FULL = r"(?s)^'(.*?)' seq:(\d+), type:(\d+) => ?(.*)$"


def parse_line(line: Column) -> Column:
    """struct(user_key, seq, value_type, value) of "key ==> value" (no sequence, no type) or "'key' seq:N, type:T => value"; null for other lines."""
    full, plain = line.rlike(_FULL), line.rlike(_PLAIN)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(line, pattern, group)

    return F.when(
        full | plain,
        F.struct(
            F.when(full, part(_FULL, 1)).otherwise(part(_PLAIN, 1)).cast("binary").alias("user_key"),
            F.when(full, part(_FULL, 2).try_cast("long")).alias("seq"),
            F.when(full, part(_FULL, 3).try_cast("int")).alias("value_type"),
            F.when(full, part(_FULL, 4)).otherwise(part(_PLAIN, 2)).cast("binary").alias("value"),
        ),
    )
