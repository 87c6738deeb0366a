"""A bitmap of hashed keys, to leave most rows of a large table out of a join with a smaller one.

A key sets one bit.  Keys of the smaller table always pass, others by chance, so
an exact join has to follow; it gets only the rows that pass.  The bitmap has
``SPARSE`` bits for each key and ``MOST_BITS`` at most, which bounds what goes
to the driver and to every executor whatever the corpus.  With more keys than
that a larger share of the other rows passes and is joined: the plan and the
result stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARSE = 64
MOST_BITS = 1 << 30
_CHUNK = 23
_U = np.uint64


def sieve(keys: DataFrame, most_bits: int | None = None) -> Broadcast:
    """keys: one long column, uniform hashes. The broadcast value goes to ``passes``."""
    column = keys.columns[0]
    n = keys.count()
    bits = min(max(10, (n * SPARSE).bit_length()), (most_bits or MOST_BITS).bit_length() - 1)
    chunk = min(bits, _CHUNK)

    def fill(rows: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        held = np.zeros(1 << chunk, bool)
        held[at & ((1 << chunk) - 1)] = True
        return pa.table({"chunk": pa.array([int(at[0]) >> chunk], pa.int32()), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    places = keys.select(F.shiftrightunsigned(F.col(column), 64 - bits).alias("at")).distinct()
    got = places.groupBy(F.shiftright("at", chunk).alias("chunk")).applyInArrow(fill, "chunk int, bits binary").collect()
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << chunk) // 8
    for row in got:
        bitmap[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast((bits, bitmap))


def passes(value: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    bits, bitmap = value
    at = (hashes.view(np.uint64) >> _U(64 - bits)).astype(np.int64)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def rows_that_pass(df: DataFrame, column: str, held: Broadcast, wanted: bool = True) -> DataFrame:
    """Rows of ``df`` whose hash in ``column`` passes, or does not."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = passes(held.value, batch.column(at).to_numpy())
            yield batch.filter(pa.array(ok == wanted))

    return df.mapInArrow(run, df.schema)
