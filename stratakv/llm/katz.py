"""Katz back-off language model over a corpus, and the scores of all its texts.

The model is a word bigram model with an end token, as in Katz (1987):

    P(w | h) = d(c(hw)) c(hw) / c(h)     if the pair was seen in training
             = a(h) P(w)                 if only the history was
             = P(w)                      otherwise

with Good-Turing discounts d for counts up to K (``LARGE`` for larger ones, so
that every history leaves some weight), P(w) discounted in the same way, its
rest going to one class of unknown words, and a(h) such that P(. | h) sums to 1
exactly: the weight that discounting frees over the weight of the words not seen
after h.

Nothing that grows with the corpus is held in one place:

1. ``counts``: words of the training texts are counted in ranges of hashes, whose
   results are stored; one row of totals reaches the driver, and then the words
   that make up more than 1 / HOT of all tokens (HOT of them at most).
2. ``events``: each token of each text goes, with its history and row, to the
   range of its word; the few most common words are spread by their history as
   well.  There the pair's and the word's counts are known, so all terms of the
   texts' sums are added up but those that need a(h).  What is left is written
   as tables, partitioned by kind: sums of rows, statistics of histories, pairs
   of history and row that back off, and counts of counts.
3. ``weights``: history ranges work out a(h) and add the terms of the rows that
   backed off.  Statistics of the common words as histories, and the counts of
   counts, are added up in ``SPREAD`` groups before they reach the driver.
4. Sums meet by row.

A word is known by a 64-bit hash, as a history too: among 10^8 words two share
one with a chance of 1 in 3,700, and then count as one word.

Cases: a null or empty text is the end token alone; long texts are scored whole;
a null id belongs to the training rows; without training rows every word is
unknown with probability 1; where a count of counts is missing, the discount is
(r - 1/2) / r; repeated rows are counted and scored each; an empty table gives
no rows; columns other than doc_id and text are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import mix, slices, words
from ._packed import give_back, pack, runs, unpack
from ._store import stored, table

K = 5
LARGE = 0.999
HOT = 1000
RANGE_BYTES = 12_000_000
SPREAD = 64
FLUSH_TOKENS = 2_500_000
_U = np.uint64
#: Hashes of the end token and of the history of a first word; no word has them but by chance.
END, BEGIN = _U(0x4E1F0D5C9B3A7711), _U(0x9A3C5E7711224466)


def discounts(seen: dict[int, int]) -> np.ndarray:
    """d(1) to d(K) from the numbers of things seen r times, and LARGE after them."""
    out = np.array([(r - 0.5) / r for r in range(1, K + 1)] + [LARGE])
    n = [seen.get(r, 0) for r in range(1, K + 2)]
    if all(n):
        over = (K + 1) * n[K] / n[0]
        good = np.array([((r + 1) * n[r] / (r * n[r - 1]) - over) / (1 - over) for r in range(1, K + 1)]) if over != 1 else np.zeros(K)
        usable = (good > 0) & (good < 1)
        out[:K][usable] = good[usable]
    return out


@dataclass
class Counts:
    """tokens, words: N and V of the training texts; hot: hashes (sorted) and counts of the most common words."""

    tokens: int
    words: int
    texts: int
    weight: float  # of all words after discounting, as counts
    discount: np.ndarray
    hot: np.ndarray
    hot_counts: np.ndarray
    ranges: int
    unknown: float = field(init=False)

    def __post_init__(self) -> None:
        self.unknown = 1 - self.weight / self.tokens if self.tokens else 1.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words seen c times."""
        d = self.discount[np.clip(c, 1, K + 1) - 1]
        return np.where(c > 0, d * c / max(self.tokens, 1), self.unknown)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of each text, end tokens among them, the row of each in the batch, and the place after each text."""
    w = words(part.column(part.schema.get_field_index("text")))
    count = w.counts + 1
    after = np.cumsum(count)
    out = np.empty(int(after[-1]) if len(after) else 0, np.uint64)
    last = np.zeros(len(out), bool)
    last[after - 1] = True
    out[last] = END
    out[~last] = w.hashes
    return out, np.repeat(np.arange(part.num_rows), count), after


def _training(ids: pa.Array, held_out: tuple[int, int]) -> np.ndarray:
    n, out = held_out
    return np.array([i is None or zlib.crc32(str(i).encode()) % n != out for i in ids.to_pylist()], bool)


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((mix(keys) >> _U(33)) % _U(ranges)).astype(np.int64)


def counts(texts: DataFrame, held_out: tuple[int, int]) -> Counts:
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).collect()[0].n
    ranges = max(1, size // RANGE_BYTES)
    parts = max(1, ranges // 2)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        texts_seen = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            order = np.argsort(key)
            bounds = runs(key[order])
            return key[order][bounds[:-1]], np.add.reduceat(n[order], bounds[:-1]) if len(key) else n

        def flush() -> pa.RecordBatch:
            key, n = merged()
            held.clear()
            part = _range(key, parts)
            order = np.argsort(part, kind="stable")
            key, n, cuts = key[order], n[order], np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist() or [0]
            own = [slice(cuts[p], cuts[p + 1]) for p in full]
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([pack(key[o], True) for o in own], pa.binary()), pa.array([pack(n[o]) for o in own], pa.binary()), pa.array([texts_seen] + [0] * (len(full) - 1), pa.int64())],
                ["part", "key", "n", "texts"],
            )

        for batch in batches:
            for piece in slices(batch, "text"):
                train = _training(piece.column(0), held_out)
                texts_seen += int(train.sum())
                token, row, _ = _tokens(piece)
                held.append(np.unique(token[train[row]], return_counts=True))
                if len(held) >= 16:
                    held[:] = [merged()]
                    if len(held[0][0]) > 3_000_000:
                        yield flush()
                        texts_seen = 0
        if held:
            yield flush()

    def add(rows: pa.Table) -> pa.Table:
        key = np.concatenate([unpack(x) for x in rows.column("key").to_pylist()])
        n = np.concatenate([unpack(x) for x in rows.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(key)
        bounds = runs(key[order])
        total = np.add.reduceat(n[order], bounds[:-1]) if len(key) else n
        key = key[order][bounds[:-1]]
        top = np.argsort(-total)[:HOT]
        small = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2]
        return pa.table({"tokens": [int(total.sum())], "words": [len(total)], "large": [int(total[total > K].sum())], "small": [small.tolist()], "texts": [sum(rows.column("texts").to_pylist())], "key": [pack(key[top])], "n": [pack(total[top])]}).cast(pa.schema([("tokens", pa.int64()), ("words", pa.int64()), ("large", pa.int64()), ("small", pa.list_(pa.int64())), ("texts", pa.int64()), ("key", pa.binary()), ("n", pa.binary())]))

    counted = texts.select("doc_id", "text").mapInArrow(emit, "part int, key binary, n binary, texts long").groupBy("part").applyInArrow(add, "tokens long, words long, large long, small array<long>, texts long, key binary, n binary")
    counted = stored(counted, "katz_counts")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "large", "texts")] + [F.coalesce(F.sum(F.col("small")[r]), F.lit(0)).alias(f"small_{r}") for r in range(K + 1)]
    total = counted.agg(*sums).collect()[0]
    tokens, small = total.tokens, [total[f"small_{r}"] for r in range(K + 1)]
    d = discounts({r + 1: int(n) for r, n in enumerate(small)})
    weight = sum(d[r - 1] * r * int(small[r - 1]) for r in range(1, K + 1)) + LARGE * total.large

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words above 1 / HOT of all tokens: HOT at most over all ranges."""
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                many = unpack(n)
                keys.append(unpack(k)[many > tokens // HOT]), counts.append(many[many > tokens // HOT])
        if sum(map(len, keys)):
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(keys).tobytes()]), pa.array([np.concatenate(counts).tobytes()])], ["key", "n"])

    got = counted.select("key", "n").mapInArrow(common, "key binary, n binary").collect()
    key = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.key, np.uint64) for r in got)])
    n = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.n, np.uint64) for r in got)]).astype(np.int64)
    order = np.argsort(key)
    return Counts(tokens, total.words, total.texts, float(weight), d, key[order], n[order], ranges)


def _is_hot(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(keys), bool)
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


# ---------------------------------------------------------------------- events

_BLOBS = 11
TABLES = "kind string, part int, " + ", ".join(f"c{i} binary" for i in range(_BLOBS))
_NAMES = ["kind", "part", *(f"c{i}" for i in range(_BLOBS))]
_ARROW = pa.schema([("kind", pa.string()), ("part", pa.int32()), *((f"c{i}", pa.binary()) for i in range(_BLOBS))])


def _record(kind: str, part: int, *blobs: bytes) -> tuple:
    return (kind, part, *blobs, *([None] * (_BLOBS - len(blobs))))


def _batch(records: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*records), _ARROW.types, strict=True)], schema=_ARROW) if records else pa.RecordBatch.from_pylist([], _ARROW)


def _floats(values: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(values, np.float64).view(np.uint64))


def _unfloats(data: bytes) -> np.ndarray:
    return unpack(data).view(np.float64)


def _row_part(rows: np.ndarray, ranges: int) -> np.ndarray:
    """Rows that stand together in the input share a part."""
    return ((rows >> _U(13)) % _U(max(1, ranges // 2))).astype(np.int64)


def _emit_events(c: Counts, held_out: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            word, history, row, train = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            spread = _is_hot(word, c.hot)
            part = _range(np.where(spread, mix(word ^ history), word), c.ranges)
            order = np.lexsort((row, history, word, part))
            cuts = np.searchsorted(part[order], np.arange(c.ranges + 1))
            out = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                o = order[cuts[p] : cuts[p + 1]]
                first = row[o].min()
                each, which = np.unique(history[o], return_inverse=True)
                out.append(_record("e", p, pack(word[o], True), pack(each, True), pack(which), pack(row[o] - first), pack(np.array([first])), pack(train[o])))
            return _batch(out)

        size = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                train = _training(piece.column(1), held_out)
                token, row, after = _tokens(piece)
                history = np.empty(len(token), np.uint64)
                history[1:] = token[:-1]
                history[np.concatenate(([0], after[:-1]))] = BEGIN
                rows = piece.column(0).to_numpy().astype(np.uint64)
                held.append((token, history, rows[row], train[row]))
                ids = piece.column(1)
                part = _row_part(rows, c.ranges)
                yield _batch([_record("m", int(p), pack(rows[o], True), np.ascontiguousarray(ids.fill_null(0).to_numpy()[o]).tobytes(), pack(ids.is_null().to_numpy(zero_copy_only=False)[o]), pack(~train[o])) for p in np.unique(part) for o in [np.flatnonzero(part == p)]])
                size += len(token)
                if size > FLUSH_TOKENS:
                    yield flush()
                    size = 0
                    give_back()
        if held:
            yield flush()
        give_back()

    return run


def _sums(rows: np.ndarray, values: Iterable[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums by row; values are made one after the other, so that one is held at a time."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    bounds = runs(ordered)
    return ordered[bounds[:-1]], [np.add.reduceat(v[order], bounds[:-1]) if len(rows) else v for v in values]


def _work_events(c: Counts):
    """A range's events: sums of rows, statistics of histories, what backs off, counts of counts."""

    def run(key: tuple, table_: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        if kind == "m":
            return table_.select(_NAMES)
        got = table_.to_pylist()
        word = np.concatenate([unpack(r["c0"]) for r in got])
        history = np.concatenate([unpack(r["c1"])[unpack(r["c2"]).view(np.int64)] for r in got])
        row = np.concatenate([unpack(r["c3"]) + unpack(r["c4"])[0] for r in got])
        train = np.concatenate([unpack(r["c5"]) for r in got]).astype(np.int64)
        del got
        order = np.lexsort((history, word))
        word, history, row, train = word[order], history[order], row[order], train[order]
        del order
        pair_new = np.ones(len(word), bool)
        pair_new[1:] = (word[1:] != word[:-1]) | (history[1:] != history[:-1])
        first = np.flatnonzero(pair_new)
        pair = np.cumsum(pair_new) - 1
        pair_count = np.add.reduceat(train, first)
        word_new = np.ones(len(first), bool)
        word_new[1:] = word[first][1:] != word[first][:-1]
        begin = np.flatnonzero(word_new)
        total = np.add.reduceat(pair_count, begin)
        own = word[first[begin]]
        spread = _is_hot(own, c.hot)
        total[spread] = c.hot_counts[np.searchsorted(c.hot, own[spread])]
        pair_total = total[np.cumsum(word_new) - 1]  # of each pair's word
        with np.errstate(divide="ignore"):
            log_word = np.log10(np.maximum(pair_total, 1))
            log_pair = np.log10(np.maximum(pair_count, 1))
            log_p = np.log10(c.probability(pair_total))
        base = np.log10((pair_total + 0.5) / (c.tokens + 0.5 * (c.words + 1)))
        seen = pair_count > 0
        # Each word but the end is the history of one more event, and that event is divided by its count.
        value = np.where(seen, log_pair, log_p) - np.where(word[first] == END, 0.0, log_word)
        band = np.where(seen, np.minimum(pair_count, K + 1), 0)
        of_event = (lambda: np.ones(len(row), np.int64), lambda: (pair_total > 0).astype(np.int64)[pair], lambda: base[pair], lambda: value[pair], *(lambda r=r: (band == r).astype(np.int64)[pair] for r in range(1, K + 2)))
        rows, sums = _sums(row, (make() for make in of_event))
        out = []
        part = _row_part(rows, c.ranges)
        for p in np.unique(part).tolist():
            o = part == p
            out.append(_record("d", p, pack(rows[o], True), pack(sums[0][o]), pack(sums[1][o]), _floats(sums[2][o]), _floats(sums[3][o]), *(pack(s[o]) for s in sums[4:])))
        # Histories of the pairs seen in training: how often, in how many pairs of each small count, and the weight of those words.
        h, stats = _sums(history[first][seen], [pair_count[seen], *((pair_count[seen] == r).astype(np.int64) for r in range(1, K + 1)), c.probability(pair_total[seen])])
        back = ~seen[pair]
        pairs_back, times = np.unique(np.column_stack((history[back], row[back])), axis=0, return_counts=True)
        hot_histories = np.unique(np.append(c.hot, BEGIN))
        is_hot = _is_hot(h, hot_histories)
        # Common histories are in all ranges; their statistics are added up in SPREAD groups.
        part_h = np.where(is_hot, -1 - _range(h, SPREAD), _range(h, c.ranges))
        spread_b = _is_hot(pairs_back[:, 0], hot_histories)
        part_b = _range(np.where(spread_b, mix(pairs_back[:, 0] ^ mix(pairs_back[:, 1])), pairs_back[:, 0]), c.ranges)
        for p in np.unique(part_h).tolist():
            o = part_h == p
            out.append(_record("h" if p >= 0 else "g", p if p >= 0 else -1 - p, pack(h[o], True), *(pack(s[o]) for s in stats[:-1]), _floats(stats[-1][o])))
        for p in np.unique(part_b).tolist():
            o = part_b == p
            out.append(_record("u", p, pack(pairs_back[o, 0], True), pack(pairs_back[o, 1]), pack(times[o])))
        out.append(_record("n", key[1].as_py() % SPREAD, pack(np.bincount(np.minimum(pair_count[seen], K + 2), minlength=K + 3)[1 : K + 2])))
        made = pa.Table.from_batches([_batch(out)])
        give_back()
        return made

    return run


# --------------------------------------------------------------------- weights


def _log_weights(total: np.ndarray, small: list[np.ndarray], lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10(a(h) c(h)): c(h) is divided by in every event already."""
    in_small = sum(r * small[r - 1] for r in range(1, K + 1))
    freed = sum((1 - d[r - 1]) * r * small[r - 1] for r in range(1, K + 1)) + (1 - LARGE) * (total - in_small)
    return np.log10(freed) - np.log10(np.maximum(1 - lower, 1e-15))


def _history_stats(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    h = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["c0"]) for r in rows)])
    values = [np.concatenate([np.zeros(0, np.int64), *(unpack(r[f"c{i}"]).astype(np.int64) for r in rows)]) for i in range(1, K + 2)]
    lower = np.concatenate([np.zeros(0), *(_unfloats(r[f"c{K + 2}"]) for r in rows)])
    return _sums(h, [*values, lower])


def _work_weights(c: Counts, d: np.ndarray, hot: np.ndarray, hot_weights: np.ndarray):
    def run(table_: pa.Table) -> pa.Table:
        got = table_.to_pylist()
        h, stats = _history_stats([r for r in got if r["kind"] == "h"])
        weight = _log_weights(stats[0], stats[1:-1], stats[-1], d) if len(h) else np.zeros(0)
        back = [r for r in got if r["kind"] == "u"]
        bh = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["c0"]) for r in back)])
        row = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["c1"]) for r in back)])
        times = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["c2"]) for r in back)]).astype(np.int64)
        value = np.zeros(len(bh))
        for keys, weights in ((h, weight), (hot, hot_weights)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, bh), len(keys) - 1)
                value = np.where(keys[at] == bh, weights[at], value)
        rows, (sums,) = _sums(row, [value * times])
        part = _row_part(rows, c.ranges)
        return pa.Table.from_batches([_batch([_record("w", p, pack(rows[part == p], True), _floats(sums[part == p])) for p in np.unique(part).tolist()])])

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(c: Counts, d: np.ndarray):
    log_d = np.log10(d)

    def run(table_: pa.Table) -> pa.Table:
        got = table_.to_pylist()
        meta = [r for r in got if r["kind"] == "m"]
        row = np.concatenate([unpack(r["c0"]) for r in meta])
        ids = np.concatenate([np.frombuffer(r["c1"], np.int64) for r in meta])
        null = np.concatenate([unpack(r["c2"]) for r in meta]).astype(bool)
        held = np.concatenate([unpack(r["c3"]) for r in meta]).astype(bool)
        order = np.argsort(row)
        row, ids, null, held = row[order], ids[order], null[order], held[order]
        tokens, known, base, value = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row)), np.zeros(len(row))
        for r in got:
            if r["kind"] in "dw":
                at = np.searchsorted(row, unpack(r["c0"]))
            if r["kind"] == "d":
                tokens[at] += unpack(r["c1"]).astype(np.int64)
                known[at] += unpack(r["c2"]).astype(np.int64)
                base[at] += _unfloats(r["c3"])
                value[at] += _unfloats(r["c4"]) + sum(log_d[i] * unpack(r[f"c{5 + i}"]).astype(np.int64) for i in range(K + 1))
            elif r["kind"] == "w":
                value[at] += _unfloats(r["c1"])
        # The first event of each text is divided by the number of training texts.
        value -= np.log10(c.texts) if c.texts else 0.0
        n = len(row)
        return pa.Table.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(held), pa.array(tokens), pa.array(known), pa.array(np.full(n, c.tokens)), pa.array(base), pa.array(value)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def score(docs: DataFrame, held_out: tuple[int, int] = (5, 1)) -> DataFrame:
    """The columns of RESULT for each text; rows whose id's crc32 has remainder ``held_out[1]`` are not learnt from."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    c = counts(texts, held_out)
    events = texts.mapInArrow(_emit_events(c, held_out), TABLES).groupBy("kind", "part").applyInArrow(_work_events(c), TABLES)
    tables = stored(events, "katz", ("kind",))
    small = [unpack(r.c0).astype(np.int64) for r in tables.where("kind = 'n'").groupBy("part").applyInArrow(_added, TABLES).select("c0").collect()]
    d = discounts({r + 1: int(n) for r, n in enumerate(np.sum(small, axis=0))} if small else {})
    # HOT + 1 histories at most, each in one group.
    common = tables.where("kind = 'g'").groupBy("part").applyInArrow(lambda t: _hot_stats(t), TABLES).collect()
    hot, stats = _history_stats([r.asDict() for r in common])
    weights = _log_weights(stats[0], stats[1:-1], stats[-1], d) if len(hot) else np.zeros(0)
    backed = tables.where("kind in ('h', 'u')").groupBy("part").applyInArrow(_work_weights(c, d, hot, weights), TABLES)
    every = tables.where("kind in ('m', 'd')").unionByName(backed)
    return every.groupBy("part").applyInArrow(_finish(c, d), RESULT)


def _added(table_: pa.Table) -> pa.Table:
    """Counts of counts of several ranges, added up."""
    return pa.Table.from_batches([_batch([_record("n", 0, pack(np.sum([unpack(x) for x in table_.column("c0").to_pylist()], axis=0)))])])


def _hot_stats(table_: pa.Table) -> pa.Table:
    h, stats = _history_stats(table_.to_pylist())
    return pa.Table.from_batches([_batch([_record("g", 0, pack(h, True), *(pack(s) for s in stats[:-1]), _floats(stats[-1]))])])


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
