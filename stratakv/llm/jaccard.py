"""Similarity self-join on sets of word shingles, by adaptive multi-match prefixes.

Two texts link if the Jaccard similarity of their sets of k-word shingles
reaches a threshold t.  Texts with equal sets form a class and are handled once.

*Order.*  Shingles are ordered from rare to frequent.  All of them are counted;
the counts of the ``FREQUENT`` most frequent ones are broadcast, and others rank
below them, by hash.  Any order gives right results, so the bound touches cost
alone.

*Prefixes.*  If x and y link, they share a = ceil(t / (1 + t) (|x| + |y|))
shingles at least, and so, for every m, the first |x| - a + m of x and the first
|y| - a + m of y share m.  A text's own m is chosen between 1 and
``MOST_MATCHES`` by the candidates it would cost, estimated from the
frequencies in its prefix, and its prefix is lengthened accordingly.

*Candidates.*  Prefixes are dealt by ranges of shingle hashes.  Each range counts
how often two texts meet in prefixes lengthened for the smaller m of both; the
counts of all ranges are added, and a pair is proposed if they reach that m.
Nothing else of the texts has been fetched by then.

First, the most central text of a list (the least of whose set is rarer than the
shingle) meets all others; verified pairs give first components.  Then all pairs
of a list that lie in different components are counted, if sizes and places
within the prefixes leave a link possible.  So a large group of near copies
costs a star, not all its pairs, and no link between components is lost.  Lists
of shingles with more than ``LIST`` texts are dealt in blocks, each block with
each; pairs are walked ``STEP`` at a time.

*Verification* bounds what the sets of a pair share by a bitmap of each set, in
which every shingle turns over one bit of about as many: bits that differ count
shingles that are not shared.  What is left is compared by the whole sets, which
are made again from the texts that pass a sieve of the pairs' ids, and joined
exactly.

A class is known by 128 bits of hashes of its set, and shingles by 64 bits.

Cases: a text of fewer than k words has its whole sequence as the only shingle;
without words, or null, a text links with nothing and is its own component; very
long texts are taken whole, and take memory in proportion; rows
that repeat an id are rows of one class or of two like any others, and a
component's id is the smallest id in it; a null id is kept, and a component with
no other id has a null id; ties of frequency fall by hash; columns other than
doc_id and text are not carried; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import mix, slices, text_buffer, windows, words
from ._packed import pack, runs, signed, unpack, unsigned
from ._sieve import passes, rows_that_pass, sieve
from ._store import stored, table, unused
from .components import components

FREQUENT = 1 << 20
MOST_MATCHES = 4
LIST = 20_000
RANGE_ROWS = 400_000
STEP = 1 << 20
_U = np.uint64
_SEEDS = (_U(0x5851F42D4C957F2D), _U(0x2545F4914F6CDD1D))


def set_hash(sets: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each set, whatever its order; 0 for the empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ _SEEDS[seed]), dtype=np.uint64)))
    n = np.diff(bounds).astype(np.uint64)
    return np.where(n > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + n * _U(0x9E3779B97F4A7C15)), _U(0))


def shingle_sets(column: pa.Array, k: int, rank: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, end to end, their ranks, and their bounds; by rank, then by hash."""
    w = words(column)
    h, bounds = windows(w.hashes, w.bounds, k)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    often = rank(h) if rank else np.ones(len(h), np.int64)
    order = np.lexsort((h, rows << 42 | often))
    h, often = h[order], often[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[new], often[new], np.searchsorted(rows[new], np.arange(len(bounds)))


@dataclass(frozen=True)
class Threshold:
    """t as a fraction, so that sizes are compared in whole numbers."""

    t: Fraction

    def links(self, shared, x, y):
        """Whether sets of x and y elements that share so many link."""
        return shared * (self.t.numerator + self.t.denominator) >= self.t.numerator * (x + y)

    def overlap(self, x, y):
        """The least number of shared elements of sets of x and y that link."""
        return -(-(x + y) * self.t.numerator // (self.t.numerator + self.t.denominator))

    def least(self, x):
        """The least size, and shared number, that links with x elements."""
        return -(-x * self.t.numerator // self.t.denominator)


# ---------------------------------------------------------------- frequencies


@dataclass(frozen=True)
class Frequencies:
    """How often the most frequent shingles occur, by the first ``bits`` bits of their hashes; keys are sorted."""

    bits: int
    keys: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        coarse = np.zeros(1 << 22, bool)
        coarse[(self.keys >> _U(self.bits - 22)).astype(np.int64)] = True
        object.__setattr__(self, "coarse", coarse)

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """The frequencies as known, 1 for shingles that are not."""
        often = np.ones(len(hashes), np.int64)
        near = np.flatnonzero(self.coarse[(hashes >> _U(42)).astype(np.int64)])
        if len(near):
            own = hashes[near] >> _U(64 - self.bits)
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            same = self.keys[at] == own
            often[near[same]] = self.counts[at[same]]
        return often

    def longer(self, n: int) -> Frequencies:
        return Frequencies(self.bits, self.keys[self.counts > n], self.counts[self.counts > n])


_STEPS = 8


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts by eighths of an octave."""
    return np.minimum(np.log2(counts) * _STEPS, 511).astype(np.int64)


def frequencies(texts: DataFrame, k: int, size: int, most: int = FREQUENT) -> Frequencies:
    """All shingles of all texts are counted, in ranges of their hashes; ``most`` of them at most reach the driver.

    A table of the counts by level gives the lowest level that keeps to that, over all ranges.  Bits follow
    ``size``, the bytes of text, so that few shingles share a key.  A shingle counts as often as it stands there.
    """
    bits = min(56, max(24, size.bit_length() + 1))
    ranges = max(1, size // 20_000_000)
    shift, per = _U(64 - bits), -(-(1 << bits) // ranges)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            held.clear()
            cut = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) * _U(per)) if ranges > 1 else np.array([0, len(keys)])
            full = np.flatnonzero(np.diff(cut)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack(keys[cut[r] : cut[r + 1]], True) for r in full], pa.binary())], ["part", "keys"])

        for batch in batches:
            for piece in slices(batch, "text"):
                w = words(piece.column(0))
                held.append(windows(w.hashes, w.bounds, k)[0] >> shift)
                if sum(map(len, held)) > 8_000_000:
                    yield flush()
        if held:
            yield flush()

    def count(rows: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([unpack(x) for x in rows.column("keys").to_pylist()]))
        bounds = runs(keys)
        n = np.diff(bounds)
        found = np.flatnonzero(n >= 3)
        levels = np.bincount(_level(n[found]), minlength=512)
        return pa.table({"keys": pa.array([pack(keys[bounds[found]], True)], pa.binary()), "counts": pa.array([pack(n[found])], pa.binary()), "levels": pa.array([levels.tolist()], pa.list_(pa.int64()))})

    counted = stored(texts.select("text").mapInArrow(emit, "part int, keys binary").groupBy("part").applyInArrow(count, "keys binary, counts binary, levels array<long>"), "frequencies")
    levels = np.zeros(512, np.int64)
    for row in counted.select(F.posexplode("levels")).where("col > 0").groupBy("pos").agg(F.sum("col").alias("n")).collect():
        levels[row.pos] = row.n
    least = 511 - int((np.cumsum(levels[::-1]) <= most).sum()) + 1

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = unpack(b)
                kept = _level(c) >= least if len(c) else np.zeros(0, bool)
                keys.append(unpack(a)[kept]), counts.append(c[kept])
        if sum(map(len, keys)):
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(keys).tobytes()]), pa.array([np.concatenate(counts).tobytes()])], ["keys", "counts"])

    got = counted.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in got)])
    counts = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["counts"], np.uint64) for r in got)]).astype(np.int64)
    order = np.argsort(keys)
    return Frequencies(bits, keys[order], counts[order])


# -------------------------------------------------------------------- prefixes


def matches_asked(often: np.ndarray, bounds: np.ndarray, limit: Threshold, most: int) -> np.ndarray:
    """The m of each text by the frequencies of its shingles in order: lists cost a step for each text in them, candidates ``verify`` steps.

    A candidate is in m lists, so the lists' sum over m bounds the number of candidates.
    """
    verify, size = 50, np.diff(bounds)
    need = limit.least(size)
    total = np.concatenate(([0], np.cumsum(often - 1)))
    best, choice = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for m in range(1, most + 1):
        length = np.minimum(size - need + m, size)
        lists = total[bounds[:-1] + length] - total[bounds[:-1]]
        cost = lists + verify * lists / m + length
        better = (m <= need) & (cost < best)
        best[better], choice[better] = cost[better], m
    return choice


def key_bits(size: int) -> int:
    """Bits of a shingle's hash that prefixes keep, whole bytes; shingles that share them only add candidates."""
    return -(-min(56, max(40, size.bit_length() + 10)) // 8) * 8


def bitmaps(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set, bits that each of its shingles turns over: as many as its size, raised to a power of two."""
    n = np.diff(bounds)
    bits = 1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    begins = np.concatenate(([0], np.cumsum(bits)))
    at = (sets & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(begins[:-1], n)
    raw = np.packbits((np.bincount(at, minlength=begins[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [raw[a >> 3 : b >> 3] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


def differ_at_least(x: bytes, y: bytes) -> int:
    """A number of shingles that two sets do not share, from their bitmaps: half of a longer one is laid on the other half."""
    p, q = (x, y) if len(x) >= len(y) else (y, x)
    value, half = int.from_bytes(p, "little"), len(p) * 4
    while half >= len(q) * 8:
        value = value & (1 << half) - 1 ^ value >> half
        half //= 2
    return (value ^ int.from_bytes(q, "little")).bit_count()


def _prefixes(texts: DataFrame, k: int, limit: Threshold, most: int, frequent: Broadcast, bits: int) -> DataFrame:
    """One row for each text: its set's size and hashes, its m, its prefix in order, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, often, bounds = shingle_sets(part.column(1), k, frequent.value.rank)
                n = np.diff(bounds)
                m = matches_asked(often, bounds, limit, most)
                length = np.where(n > 0, n - limit.least(n) + m, 0)
                raw = np.ascontiguousarray((sets >> _U(64 - bits)).view(np.uint8).reshape(-1, 8)[:, : bits // 8]).tobytes()
                width = bits // 8
                prefixes = [raw[a * width : (a + p) * width] for a, p in zip(bounds[:-1].tolist(), length.tolist(), strict=True)]
                hashes = [pa.array(signed(set_hash(sets, bounds, seed)), pa.int64()) for seed in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), *hashes, pa.array(m, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(bitmaps(sets, bounds), pa.binary())], ["doc_id", "digest", "n", "hash", "proof", "matches", "prefix", "bitmap"])

    return texts.select("doc_id", "text", "digest").mapInArrow(run, "doc_id long, digest long, n long, hash long, proof long, matches int, prefix binary, bitmap binary")


# ------------------------------------------------------------------ candidates


@dataclass
class Lists:
    """Places of texts in lists, sorted by list. at: the shingle's place in its set; side: 2, or 0 and 1 where only sides that differ meet."""

    node: np.ndarray
    component: np.ndarray
    n: np.ndarray
    matches: np.ndarray
    at: np.ndarray
    side: np.ndarray
    bounds: np.ndarray

    def possible(self, limit: Threshold, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether places i and j lie in the prefixes in which linking sets share the smaller m, and that m."""
        need = np.minimum(self.matches[i], self.matches[j])
        least = limit.overlap(self.n[i], self.n[j])
        ok = (np.minimum(self.n[i], self.n[j]) >= least) & (self.at[i] < self.n[i] - least + need) & (self.at[j] < self.n[j] - least + need)
        return ok & ((self.side[i] != self.side[j]) | (self.side[i] == 2)), need


def stars(lists: Lists, limit: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the most central text of each list, and of all others."""
    length = np.diff(lists.bounds)
    which = np.repeat(np.arange(len(length)), length)
    # The smallest share of its set before the shingle, then the smallest id.
    order = np.lexsort((lists.node, lists.at / lists.n, which))
    hub = order[lists.bounds[:-1]][which] if len(which) else order
    for lo in range(0, len(which), STEP):
        i = np.arange(lo, min(lo + STEP, len(which)))
        other = lists.node[i] != lists.node[hub[i]]
        yield i[other], hub[i][other]


def across(lists: Lists, limit: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of each list in different components whose sizes suit."""
    up, down = limit.t.numerator, limit.t.denominator
    length = np.diff(lists.bounds)
    if not len(length):
        return
    which = np.repeat(np.arange(len(length)), length)
    begins = lists.bounds[:-1]
    mixed = np.minimum.reduceat(lists.component, begins) < np.maximum.reduceat(lists.component, begins)
    # The largest partner that a text's place allows; texts that no size in the list suits are left out.
    n = lists.n
    reach = (n - lists.at + lists.matches - 1) * (up + down) // up - n
    alive = np.flatnonzero(mixed[which] & (reach >= np.maximum(limit.least(n), np.minimum.reduceat(n, begins)[which])))
    order = which[alive] << 32 | n[alive]
    by = np.argsort(order, kind="stable")
    alive, order = alive[by], order[by]
    end = np.searchsorted(order, (order >> 32 << 32) + n[alive] * down // up, "right")
    width = end - np.arange(len(alive)) - 1
    ends = np.concatenate(([0], np.cumsum(width)))
    lo = 0
    while lo < len(alive):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + STEP, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), width[lo:hi])
        j = i + 1 + np.arange(int(ends[hi] - ends[lo])) - np.repeat(ends[lo:hi] - ends[lo], width[lo:hi])
        i, j = alive[i], alive[j]
        apart = lists.component[i] != lists.component[j]
        yield i[apart], j[apart]
        lo = hi


def count_pairs(a: np.ndarray, b: np.ndarray, count: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs, sorted, with the sum of their counts."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    begins = np.flatnonzero(first)
    return low[begins], high[begins], np.add.reduceat(count[order], begins) if len(begins) else count, need[order][begins]


def proposals(classes: DataFrame, total: int, limit: Threshold, bits: int, long_lists: Frequencies, longest: int, walk: Callable) -> DataFrame:
    """Pairs (a, b) of classes (node, component, n, matches, prefix) that ``walk`` meets often enough for the smaller m of both.

    Ranges of shingle hashes count the pairs that they meet, and pass them on by a hash of the pair, where the counts are added.
    """
    ranges = max(1, total // RANGE_ROWS)
    parts = max(16, ranges // 16)
    hot = classes.sparkSession.sparkContext.broadcast(long_lists)
    names = ["key", "node", "comp", "n", "matches", "at", "side"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
            held.clear()
            key = columns[0]
            part = (key * _U(0x9E3779B97F4A7C15) >> _U(33)) % _U(ranges)
            order = np.lexsort((key, part))
            cuts = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
            columns = [c[order] for c in columns]
            full = np.flatnonzero(np.diff(cuts)).tolist()
            blobs = [[pack(c[cuts[r] : cuts[r + 1]], i == 0) for r in full] for i, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], ["part", *names])

        size = 0
        for batch in batches:
            node, comp = unsigned(batch.column(0).to_numpy()), unsigned(batch.column(1).to_numpy())
            n, matches = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            raw, offsets = text_buffer(batch.column(4))
            length = np.diff(offsets) // (bits // 8)
            if not length.sum():
                continue
            wide = np.zeros((len(raw) // (bits // 8), 8), np.uint8)
            wide[:, : bits // 8] = raw.reshape(-1, bits // 8)
            key = wide.view(np.uint64).reshape(-1)
            row = np.repeat(np.arange(len(length)), length)
            at = np.arange(len(key)) - np.repeat(np.cumsum(length) - length, length)
            key, row, at, side = blocked(key, row, at, node, bits, hot.value, longest)
            held.append((key, node[row], comp[row] ^ node[row], n[row], matches[row], at, side))
            size += len(key)
            if size > 3_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    def meet(rows: pa.Table) -> pa.Table:
        columns = [np.concatenate([unpack(x) for x in rows.column(c).to_pylist()]) for c in names]
        order = np.argsort(columns[0], kind="stable")
        key, node, comp, n, matches, at, side = (c[order] for c in columns)
        lists = Lists(node, comp ^ node, *(c.astype(np.int64) for c in (n, matches, at, side)), runs(key))
        met: list[tuple[np.ndarray, ...]] = []
        made: list[tuple[int, list[bytes]]] = []
        size = 0

        def merge(out: bool) -> None:
            low, high, count, need = count_pairs(*(np.concatenate([x[i] for x in met]) for i in range(4)))
            met.clear()
            if not out and len(low) <= 2 * STEP:
                met.append((low, high, count, need))
                return
            part = (mix(low * _U(3) ^ mix(high)) % _U(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                o = by[cuts[p] : cuts[p + 1]]
                made.append((p, [pack(low[o], True), pack(high[o]), pack(count[o]), pack(need[o])]))

        for i, j in walk(lists, limit):
            ok, need = lists.possible(limit, i, j)
            met.append((node[i[ok]], node[j[ok]], np.ones(int(ok.sum()), np.int64), need[ok]))
            size += int(ok.sum())
            if size > 4 * STEP:
                merge(False)
                size = sum(len(x[0]) for x in met)
        if met:
            merge(True)
        return pa.table([pa.array([p for p, _ in made], pa.int32()), *(pa.array([b[i] for _, b in made], pa.binary()) for i in range(4))], ["part", "a", "b", "count", "need"])

    def add(rows: pa.Table) -> pa.Table:
        low, high, count, need = count_pairs(*(np.concatenate([unpack(x) for x in rows.column(c).to_pylist()]) for c in ("a", "b", "count", "need")))
        enough = count >= need
        return pa.table({"a": pa.array(signed(low[enough]), pa.int64()), "b": pa.array(signed(high[enough]), pa.int64())})

    dealt = classes.select("node", "component", "n", "matches", "prefix").mapInArrow(deal, "part int, " + ", ".join(f"{c} binary" for c in names))
    counted = dealt.groupBy("part").applyInArrow(meet, "part int, a binary, b binary, count binary, need binary")
    return counted.groupBy("part").applyInArrow(add, "a long, b long")


def blocked(key: np.ndarray, row: np.ndarray, at: np.ndarray, node: np.ndarray, bits: int, long_lists: Frequencies, longest: int):
    """Gives each place in a list of more than ``longest`` texts a key for each pair of blocks that its text's block is in, and its side."""
    own = key >> _U(bits - long_lists.bits) if len(long_lists.keys) else key
    k = np.minimum(np.searchsorted(long_lists.keys, own), max(0, len(long_lists.keys) - 1))
    hit = np.flatnonzero(long_lists.keys[k] == own) if len(long_lists.keys) else np.zeros(0, np.int64)
    whole = np.full(len(key), 2, np.int64)
    if not len(hit):
        return key, row, at, whole
    blocks = -(-long_lists.counts[k[hit]] // longest)
    mine = (mix(node[row[hit]]) % blocks.astype(np.uint64)).astype(np.int64)
    copy = np.repeat(np.arange(len(hit)), blocks)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = mine[copy]
    pair = (np.minimum(own, other) * (1 << 20) + np.maximum(own, other)).astype(np.uint64)
    new = mix(key[hit][copy] ^ mix(pair + _U(1))) >> _U(64 - bits)
    side = np.where(own == other, 2, own > other)
    rest = np.ones(len(key), bool)
    rest[hit] = False
    return np.concatenate((key[rest], new)), np.concatenate((row[rest], row[hit][copy])), np.concatenate((at[rest], at[hit][copy])), np.concatenate((whole[rest], side))


# ---------------------------------------------------------------- verification


def _id_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit(-1).cast("long")), F.col(column).isNull())


def _near(limit: Threshold, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) without those whose bitmaps show that too many shingles differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            most = m + n - 2 * limit.overlap(m, n)
            differ = [differ_at_least(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(np.array(differ, np.int64) <= most))

    def side(of: str, n: str, bitmap: str) -> DataFrame:
        return classes.select(F.col("node").alias(of), F.col("n").alias(n), F.col("bitmap").alias(bitmap))

    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return both.select("a", "b", "m", "x", "n", "y").mapInArrow(run, "a long, b long")


def _linked(texts: DataFrame, k: int, limit: Threshold, proposed: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the proposed pairs (a, b) whose sets link.

    Bitmaps leave out most others. The sets come from texts whose id passes the sieve of the classes' first ids; a join by the sets' hashes leaves out the rest.
    """
    pairs = stored(_near(limit, proposed, classes), "near")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(nodes.join(classes.select("node", "hash", "proof", "first_id"), "node"), "wanted")
    held = sieve(wanted.select(_id_hash("first_id")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            batch = batch.filter(pa.array(passes(held.value, batch.column(1).to_numpy())))
            for part in slices(batch, "text"):
                sets, _, bounds = shingle_sets(part.column(0), k)
                one, two = (signed(set_hash(sets, bounds, seed)) for seed in (0, 1))
                rows = []
                for r in np.flatnonzero(np.diff(bounds)).tolist():
                    mark = (int(one[r]), int(two[r]))
                    if mark not in sent:
                        rows.append(r)
                        if len(sent) < 100_000:
                            sent.add(mark)
                yield pa.RecordBatch.from_arrays([pa.array(one[rows], pa.int64()), pa.array(two[rows], pa.int64()), pa.array([pack(sets[bounds[r] : bounds[r + 1]], True) for r in rows], pa.binary())], ["hash", "proof", "items"])

    sets = stored(texts.select("text", _id_hash("doc_id").alias("by")).mapInArrow(make, "hash long, proof long, items binary"), "sets")
    if sets.select("hash", "proof").distinct().count() < sets.count():
        # Rows that repeat an id and a set, met by several tasks.
        sets = stored(sets.groupBy("hash", "proof").agg(F.max("items").alias("items")), "sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, p = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, p = x, unpack(x)
                q = unpack(y)
                keep.append(bool(limit.links(len(np.intersect1d(p, q, True)), len(p), len(q))))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def with_set(df: DataFrame, side: str, name: str) -> DataFrame:
        of = wanted.select(F.col("node").alias(side), F.col("hash").alias("h"), F.col("proof").alias("p"))
        return df.join(of, side).join(sets.select(F.col("hash").alias("h"), F.col("proof").alias("p"), F.col("items").alias(name)), ["h", "p"]).drop("h", "p")

    return with_set(with_set(pairs, "a", "x"), "b", "y").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


# ------------------------------------------------------------------- the join


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))


def self_join(docs: DataFrame, k: int = 5, t: Fraction = Fraction(4, 5), most: int = MOST_MATCHES, longest: int = LIST) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), n_shingles, component (its smallest class; null for texts without words) and component_id of each row."""
    limit = Threshold(Fraction(t))
    texts = _texts(docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0].n
    counted, bits = frequencies(texts, k, size), key_bits(size)
    frequent = docs.sparkSession.sparkContext.broadcast(counted)
    rows = stored(_prefixes(texts, k, limit, most, frequent, bits), "prefixes")
    full = rows.where("n > 0")
    classes = full.groupBy("hash", "proof").agg(F.min("doc_id").alias("first_id"), *(F.max(c).alias(c) for c in ("n", "matches", "prefix", "bitmap")))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    total = int(classes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)).alias("n")).collect()[0].n) // (bits // 8)
    of = (total, limit, bits, counted.longer(longest), longest)
    first = stored(proposals(classes.withColumn("component", F.col("node")), *of, stars), "stars")
    links = stored(_linked(texts, k, limit, first, classes), "links")
    found = components(links)
    known = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    second = stored(proposals(known, *of, across), "across")
    more = stored(_linked(texts, k, limit, second, classes), "links")
    if not more.isEmpty():
        found = components(links.unionAll(more))
    of_class = classes.select("node", "hash", "proof", "first_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = stored(of_class.join(smallest, "component").select("hash", "proof", "component", "component_id"), "class_components")
    out = full.select("doc_id", "digest", F.col("n").alias("n_shingles"), "hash", "proof").join(of_class, ["hash", "proof"]).drop("hash", "proof")
    return out.unionAll(rows.where("n = 0").select("doc_id", "digest", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, t: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with their columns as they were.

    One row stays of those that repeat an id and a set, and of a component
    without ids; texts without words all stay.  Rows are known again by id and
    digest; only those that pass the sieve of the rows to look up are joined.
    """
    joined = stored(self_join(docs, k, t).where("n_shingles > 0"), "joined")
    keeper = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = joined.where(~keeper).select("doc_id", "digest", F.lit(None).cast("long").alias("component")).distinct()
    crowded = joined.where(keeper).groupBy("component").agg(F.count("*").alias("rows")).where("rows > 1").select("component")
    contested = joined.where(keeper).join(crowded, "component").select("doc_id", "digest", "component").distinct()
    verdicts = stored(gone.unionAll(contested), "verdicts")
    held = sieve(verdicts.select(F.xxhash64(_id_hash("doc_id"), "digest")))
    by, digest = (unused(docs, n) for n in ("_by", "_digest"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(digest, F.xxhash64(text))
    keyed = keyed.withColumn(by, F.xxhash64(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), F.col("doc_id").cast("long").isNull()), digest))
    names = docs.columns
    clear = rows_that_pass(keyed, by, held, False).select(*names)
    row, f = F.struct(*names).alias("row"), verdicts.alias("f")
    unsure = rows_that_pass(keyed, by, held).select(F.col("doc_id").cast("long").alias("id"), F.col(digest).alias("digest"), row).alias("d")
    looked_up = unsure.join(f, F.col("d.id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.digest") == F.col("f.digest")), "left")
    looked_up = stored(looked_up.select("row", F.col("f.digest").isNotNull().alias("known"), F.col("f.component").alias("component")).where("NOT known OR component IS NOT NULL"), "looked_up")
    one = looked_up.where("known").groupBy("component").agg(F.first("row").alias("row"))
    return clear.unionByName(looked_up.where("NOT known").select("row.*")).unionByName(one.select("row.*"))


def op5_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_join(table(spark, sf_dir, "documents"), 4, Fraction(85, 100)).select("doc_id", "n_shingles", "component_id")
