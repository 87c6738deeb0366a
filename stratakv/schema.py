"""The entries schema that every operator takes and returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("value_type", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), False),
        T.StructField("source_id", T.IntegerType(), True),
    ]
)

DELETION, VALUE, MERGE, SINGLE_DELETION, RANGE_DELETION, BLOB_INDEX = 0, 1, 2, 7, 15, 17

#: Names of the operation types by their byte.
TYPE_NAMES = {DELETION: "Deletion", VALUE: "Value", MERGE: "Merge", SINGLE_DELETION: "SingleDeletion", RANGE_DELETION: "RangeDeletion", BLOB_INDEX: "BlobIndex"}

TOMBSTONES = (DELETION, SINGLE_DELETION)
MAX_SEQ = (1 << 56) - 1


def type_name(value_type: Column) -> Column:
    """The name of a type byte; an unknown byte b is shown as Other(b)."""
    name = F.concat(F.lit("Other("), value_type.cast("string"), F.lit(")"))
    for byte, text in TYPE_NAMES.items():
        name = F.when(value_type == byte, text).otherwise(name)
    return name
