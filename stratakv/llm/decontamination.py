"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of ``span`` tokens of which a fixed mask keeps some: tokens at
the other places may differ without changing the seed's hash.  Hashes of all
windows of the test items, under several masks, are joined with the hashes of
all windows of the training texts.  Each hit proposes an alignment of text and
item; the tokens along it are compared, and the alignment counts if some
stretch of ``least`` tokens (the whole item where that is shorter) agrees in
``similarity`` of them.  So passages with replaced words are found, and chance
hits are not.

Tokens are runs of letters and digits, ASCII letters folded, so punctuation,
case and line breaks do not matter.  Items of fewer than ``shortest`` tokens
prove nothing and are not searched for.  Items shorter than a mask are looked up
by masks of their own length, which leave out the places of every choice of as
many blocks of tokens as there may be differing tokens, so none that agrees
enough is missed.

The test side is read in blocks of at most about ``BLOCK_BYTES`` of text, by a
hash of the item; each block's index is broadcast and met by one narrow pass
over the training texts, so neither side is shuffled and the broadcast is
bounded whatever the benchmark's size.

Cases: null or empty texts and items match nothing; very long texts are searched
whole, and one that repeats its words in a longer period costs a step for each
pair of equal seeds in text and item; a null id is kept; repeated
rows are reported each; ties of agreement take the earliest place; with an empty
table the result is empty; other columns are not carried into the matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import ALNUM, Words, mix, slices, words
from ._sieve import passes
from ._store import table

#: Kept places of each mask, by its span.
MASKS = ("1101100101", "1110010011", "11010001011", "1011011001", "11111", "110111")
LEAST = 16
SIMILARITY = 0.8
SHORTEST = 8
BLOCK_BYTES = 4_000_000
STEP = 1 << 20
_MULT = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of the window that begins at each token (of those where one fits)."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _MULT[63 - salt], np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out += hashes[j : n + j] * _MULT[j]
    return mix(out)


def short_masks(n: int, similarity: float) -> list[str]:
    """Masks for items of ``n`` tokens, one of which keeps no place that differs if at most 1 - ``similarity`` of them do."""
    differ = n - int(np.ceil(similarity * n - 1e-9))
    blocks = np.array_split(np.arange(n), max(differ + 1, n // 2))
    left_out = [{p for block in chosen for p in block.tolist()} for chosen in combinations(blocks, differ)]
    return ["".join("0" if p in out else "1" for p in range(n)) for out in left_out]


@dataclass
class Index:
    """Seeds of a block of items, by sorted hash; tokens of the items end to end."""

    ids: list
    tokens: np.ndarray
    bounds: np.ndarray
    parts: list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # mask, salt, sorted hash, item, place; where runs of one seed begin
    least: int
    similarity: float

    @staticmethod
    def build(ids: list, texts: list[str], masks: tuple[str, ...], least: int, similarity: float, shortest: int) -> Index:
        w = words(pa.array(texts, pa.large_string()), ALNUM)
        index = Index(ids, w.hashes, w.bounds, [], least, similarity)
        longest = max(map(len, masks))
        size = np.diff(w.bounds)
        plans = [(m, longest, None) for m in masks] + [(m, n, n) for n in np.unique(size[(size >= max(shortest, 1)) & (size < longest)]).tolist() for m in short_masks(n, similarity)]
        for salt, (mask, low, high) in enumerate(plans):
            keys, items, places = [], [], []
            for i in np.flatnonzero((size >= low) & (size <= (high or size.max(initial=0)))).tolist():
                own = seeds(w.hashes[w.bounds[i] : w.bounds[i + 1]], mask, salt)
                keys.append(own), items.append(np.full(len(own), i)), places.append(np.arange(len(own)))
            if keys:
                key, item, place = np.concatenate(keys), np.concatenate(items), np.concatenate(places)
                order = np.lexsort((place, item, key))
                key, item, place = key[order], item[order], place[order]
                begins = np.ones(len(key), bool)
                begins[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)
                index.parts.append((mask, salt, key, item, place, np.flatnonzero(begins)))
        return index

    def prepare(self) -> None:
        """Bitmaps that tell most hashes from those of the items."""
        self.bits = []
        for _, _, key, *_ in self.parts:
            size = max(16, int(np.ceil(np.log2(len(key) * 64))))
            at = (key >> np.uint64(64 - size)).astype(np.int64)
            bitmap = np.zeros(1 << size - 3, np.uint8)
            np.bitwise_or.at(bitmap, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            self.bits.append((size, bitmap))

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        """Distinct (place in the text minus place in the item, item) of all shared seeds; tokens of several texts may be end to end.

        Where a token is repeated, seeds follow each other that are equal.  Two such runs of L and M places have L + M - 1
        differences, which the first place of either with all of the other gives; ``STEP`` pairs are held at a time.
        """
        found = np.zeros((0, 2), np.int64)
        for (mask, salt, key, item, place, begins), bits in zip(self.parts, self.bits, strict=True):
            own = seeds(tokens, mask, salt)
            at = np.flatnonzero(passes(bits, own))
            if not len(at):
                continue
            repeats = np.zeros(len(own), bool)
            repeats[1:] = own[1:] == own[:-1]
            for places, entries in ((at[~repeats[at]], np.arange(len(key))), (at[repeats[at]], begins)):
                keys = key[entries]
                lo, hi = np.searchsorted(keys, own[places], "left"), np.searchsorted(keys, own[places], "right")
                some = hi > lo
                places, lo, count = places[some], lo[some], (hi - lo)[some]
                ends = np.concatenate(([0], np.cumsum(count)))
                a = 0
                while a < len(places):
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + STEP, "right")) - 1)
                    k = entries[np.repeat(lo[a:b] - ends[a:b], count[a:b]) + np.arange(ends[a], ends[b])]
                    found = np.unique(np.concatenate((found, np.column_stack((np.repeat(places[a:b], count[a:b]) - place[k], item[k])))), axis=0)
                    a = b
        return found

    def verify(self, tokens: np.ndarray, diagonal: int, item: int) -> tuple[int, int, int, int] | None:
        """(start, end, equal, compared) of the best stretch along a diagonal, in tokens of the text; None if it is too unlike."""
        own = self.tokens[self.bounds[item] : self.bounds[item + 1]]
        lo, hi = max(0, diagonal), min(len(tokens), diagonal + len(own))
        need = min(self.least, len(own))
        if hi - lo < need:
            return None
        same = tokens[lo:hi] == own[lo - diagonal : hi - diagonal]
        total = np.concatenate(([0], np.cumsum(same)))
        good = np.flatnonzero(total[need:] - total[:-need] >= self.similarity * need - 1e-9)
        if not len(good):
            return None
        start, end = int(good[0]), int(good[-1]) + need
        return lo + start, lo + end, int(total[end] - total[start]), end - start

    def overlaps(self, texts: Words) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
        """(text, item, best stretch) of all alignments that hold.

        Texts stand end to end, so a seed may run from one into the next; the comparison keeps to one text.
        """
        for diagonal, item in self.hits(texts.hashes).tolist():
            end = min(diagonal + int(self.bounds[item + 1] - self.bounds[item]), len(texts.hashes))
            first, last = np.searchsorted(texts.bounds, (max(diagonal, 0), end - 1), "right") - 1
            for row in range(int(first), int(last) + 1):
                a, b = texts.bounds[row], texts.bounds[row + 1]
                if got := self.verify(texts.hashes[a:b], int(diagonal - a), item):
                    yield row, item, got


MATCHES = "doc_id long, item_id long, start_word long, end_word long, equal_words long, item_words long, overlap double"


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0].n
    blocks = max(1, -(-total // BLOCK_BYTES))
    for k in range(blocks):
        rows = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        if rows:
            yield [r.item_id for r in rows], [r.text for r in rows]


def _search(docs: DataFrame, index: Index) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        own.prepare()
        size = np.diff(own.bounds)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(1), ALNUM)
                best: dict[tuple[int, int], tuple] = {}
                for row, item, got in own.overlaps(w):
                    now = best.get((row, item))
                    if now is None or (got[2], -got[0]) > (now[2], -now[0]):
                        best[row, item] = got
                rows = sorted(best.items())
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[r] for (r, _), _ in rows], pa.int64()),
                        pa.array([own.ids[i] for (_, i), _ in rows], pa.int64()),
                        *(pa.array([v[k] for _, v in rows], pa.int64()) for k in range(3)),
                        pa.array([int(size[i]) for (_, i), _ in rows], pa.int64()),
                        pa.array([v[2] / v[3] for _, v in rows], pa.float64()),
                    ],
                    names=[x.split()[0] for x in MATCHES.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MATCHES)


def matches(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST, similarity: float = SIMILARITY, shortest: int = SHORTEST) -> DataFrame:
    """One row for each text and item that overlap: the best stretch, in tokens of the text."""
    found = [_search(docs, Index.build(*block, masks, least, similarity, shortest)) for block in _blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST, similarity: float = SIMILARITY, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` without an overlap with any item, with their columns as they were."""
    kept = docs
    for block in _blocks(benchmark):
        kept = _without(kept, Index.build(*block, masks, least, similarity, shortest))
    return kept


def _without(docs: DataFrame, index: Index) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        own.prepare()
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(part.schema.get_field_index("text")), ALNUM)
                bad = np.zeros(part.num_rows, bool)
                for row, _, _ in own.overlaps(w):
                    bad[row] = True
                yield part.filter(pa.array(~bad))

    return docs.mapInArrow(run, docs.schema)


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
