"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Each document is tokenised, ended with one separator id and cut into pieces
only where it is longer than a sequence.  Pieces are then placed one by one:
with N(g) open sequences that have g places left, a piece goes where the sum of
N(g)^2 over all g becomes smallest (Csirik, Johnson, Kenyon, Orlin, Shor and
Weber's sum-of-squares rule).  The rule needs only the counts by gap, so a step
costs at most ``capacity`` operations whatever the number of open sequences.

Packing runs in independent lots of at most about ``lot`` pieces, dealt by a
hash of the piece: each lot is one bounded task, no task sees the whole corpus,
and a lot that is lost with its executor is packed again alone.  A lot leaves
open sequences only at its end, so the waste is a fraction of 1 / lot.

Cases: a null or empty text is one piece that holds the separator alone; a null
doc_id is kept; repeated rows are packed each; a very long text is tokenised
whole; where several gaps are as good, the smallest is taken; an empty table
gives no rows;
other columns of the input, whatever their names, are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import LOWER, NON_SPACE, slices, words
from ._store import stored, table

CAPACITY = 4096
SEPARATOR = 1
LOT = 20_000
_CACHE = 1_500_000

#: 1: ASCII letters and digits; 2: ASCII punctuation; 3: the apostrophe and non-ASCII. A word is cut only between 1 and 2, where no pre-token crosses.
_KINDS = np.full(256, 2, np.uint8)
_KINDS[48:58] = _KINDS[65:91] = _KINDS[97:123] = 1
_KINDS[39] = _KINDS[128:] = 3
_PLAIN = re.compile("[a-zà-öø-ÿÀ-ÖØ-Þ]+")

#: Byte-level vocabularies write a byte that is no visible Latin-1 character as the next free code point from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class UnitEncoder:
    """Token ids of whole texts, from the ids of their distinct units.

    A unit is a stretch without white space that the tokenizer treats alike
    wherever it stands.  Ids of units are kept in sorted arrays and dropped when
    there are more than ``limit``, which bounds memory.
    """

    def __init__(self, path: str, limit: int = _CACHE) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.sizes = np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and the number for each unit.

        A unit of Latin letters is one pre-token, so the BPE model itself takes
        its bytes; any other unit passes through the whole tokenizer.
        """
        model = self.tokenizer.model.tokenize
        lists: list[list[int]] = []
        rest = []
        for i, unit in enumerate(units):
            if _PLAIN.fullmatch(unit):
                text = unit if unit.isascii() else unit.lower().encode().decode("latin-1").translate(_BYTE_CHARS)
                lists.append([t.id for t in model(text)])
            else:
                lists.append([])
                rest.append(i)
        for lo in range(0, len(rest), 5000):
            part = rest[lo : lo + 5000]
            for i, e in zip(part, self.tokenizer.encode_batch([units[i] for i in part], add_special_tokens=False), strict=True):
                lists[i] = e.ids
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def learn(self, keys: np.ndarray, units: list[str]) -> None:
        flat, sizes = self.encode_units(units)
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.keys, keys)
        self.keys, self.sizes, self.begins = np.insert(self.keys, at, keys), np.insert(self.sizes, at, sizes), np.insert(self.begins, at, begins)
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their n+1 bounds."""
        w = words(column, NON_SPACE, LOWER, _KINDS)
        distinct, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == distinct[at < len(self.keys)]
        if not known.all():
            raw, new = LOWER[w.data].tobytes(), first[~known]
            self.learn(distinct[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[new].tolist(), w.ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        sizes, begins = self.sizes[at][which], self.begins[at][which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[w.bounds]
        raw = w.data.tobytes()
        if any(s.encode() in raw for s in self.special):
            return self._with_special(column, out, bounds)
        return out, bounds

    def _with_special(self, column: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that hold a special token's string are encoded whole."""
        parts = np.split(ids, bounds[1:-1])
        for i, text in enumerate(column.to_pylist()):
            if text and any(s in text for s in self.special):
                parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


@lru_cache(maxsize=2)
def _encoder(path: str) -> UnitEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitEncoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; ``ids`` too if asked for."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1 << 23):
                ids, bounds = encoder.encode(part.column(1))
                owner, number, start, length, crc, held = [], [], [], [], [], []
                for row, doc in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[bounds[row] : bounds[row + 1]], np.uint32(separator)).astype("<u4")
                    for k, lo in enumerate(range(0, len(own), capacity)):
                        piece = own[lo : lo + capacity]
                        owner.append(doc), number.append(k), start.append(lo), length.append(len(piece)), crc.append(zlib.crc32(piece.tobytes()))
                        if with_ids:
                            held.append(piece.astype(np.int32))
                columns = [pa.array(owner, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item, placed in the given order."""
    open_at = np.zeros(capacity + 1, np.int64)  # by gap, of started bins that have room
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        # Growth of the sum if the item goes into a bin of gap g: N(g) loses one, N(g - s) gains one; a full bin counts for nothing.
        gaps = open_at[s:]
        cost = 2 * (open_at[: capacity + 1 - s] - gaps) + 2
        cost[0] = 1 - 2 * gaps[0]
        if s != 0:
            cost[capacity - s] = 2 * open_at[capacity - s] + 1 if s < capacity else 0
        usable = gaps > 0
        usable[capacity - s] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        gap = s + int(np.argmin(cost))
        if gap == capacity and not stacks[capacity]:
            bin_id, made = made, made + 1
        else:
            bin_id = stacks[gap].pop()
            open_at[gap] -= 1
        bins[i], places[i] = bin_id, capacity - gap
        if gap > s:
            stacks[gap - s].append(bin_id)
            open_at[gap - s] += 1
    return bins, places


def pack(items: DataFrame, capacity: int = CAPACITY, lot: int = LOT) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length."""
    total = items.count()
    lots = max(1, -(-total // lot))
    names = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        order = np.lexsort((rows.column("piece").to_numpy(), rows.column("doc_id").fill_null(-1).to_numpy(), -lengths))
        bins, places = sum_of_squares(lengths[order], capacity)
        out = rows.take(pa.array(order)).select(names)
        number = np.int64(key[0].as_py()) * np.int64(1 << 32) + bins
        return out.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(places, pa.int64()))

    dealt = items.withColumn("_lot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(lots)))
    return dealt.groupBy("_lot").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, lot: int = LOT, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; the pieces are stored once, as both the count and the packing read them."""
    made = pieces(docs, tokenizer or default_tokenizer(), capacity, with_ids=with_ids)
    return pack(stored(made, "pieces"), capacity, lot)


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
