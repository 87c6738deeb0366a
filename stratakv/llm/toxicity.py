"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct terms (runs of letters and digits, ASCII
letters folded), each known by a 64-bit hash.  The model is a bias, a weight
and a vector of ``rank`` numbers for each kept hash; the score is the logistic
function of

    bias + sum of weights + sum over pairs of terms of the product of their vectors

so that two terms together, an insult next to a mention of a group, can weigh
more or less than the sum of both.  The pair sum costs one pass over the terms.

Learning takes at most ``TRAIN_ROWS`` labelled rows, those whose id hashes
lowest, and keeps the terms that ``LEAST_DOCS`` of them contain and whose
share of toxic rows stands ``LEAST_Z`` standard errors off the mean.  The model is
therefore of bounded size at any size of the corpus, and scoring is one narrow
pass over all texts.

Cases: a null or empty text gets the score of the bias; a very long text is
scored whole; a null id is no training row, nor held out; ties of hashes
fall by id, then label; labels that are null or not 0 or 1 are left out, and without any
label the score is 0; repeated rows are scored each; tables may be empty; the
input's other columns pass through, and one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import ALNUM, slices, words
from ._store import id_remainder, stored, table

TRAIN_ROWS = 20_000
LEAST_DOCS = 3
LEAST_Z = 3.0
RANK = 4
STEPS = 4000
THRESHOLD = 0.7


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def scores(self, feature: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.scale * self.logits(feature, row, rows) - self.shift))

    def logits(self, feature: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Of ``rows`` texts; text ``row[i]`` has the kept term ``feature[i]``."""
        linear = np.bincount(row, self.weights[feature], rows)
        v = self.vectors[feature]
        pairs = np.zeros(rows)
        for f in range(v.shape[1]):
            pairs += np.bincount(row, v[:, f], rows) ** 2 - np.bincount(row, v[:, f] ** 2, rows)
        return self.bias + linear + pairs / 2

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those hashes that the model has, and their features."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == hashes)
        return places, at[places]


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct term hashes, and the texts they belong to, in order."""
    w = words(column, ALNUM)
    rows = w.rows()
    order = np.lexsort((w.hashes, rows))
    h, r = w.hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def _telling(docs: np.ndarray, toxic: np.ndarray, rows: int, share: float, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> np.ndarray:
    """Which terms to keep, by the rows and toxic rows that contain them."""
    z = (toxic - docs * share) / np.sqrt(docs * share * (1 - share))
    return (docs >= least_docs) & (np.abs(z) >= least_z)


def _share(positive: float, rows: int) -> float:
    return float(np.clip(positive / rows, 1e-4, 1 - 1e-4)) if rows else 0.5


def terms_kept(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The sorted hashes of the terms that a model of these rows keeps."""
    every = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    hashes, which, docs = np.unique(every, return_inverse=True, return_counts=True)
    toxic = np.bincount(which, np.repeat(labels, [len(t) for t in texts]), len(hashes))
    return hashes[_telling(docs, toxic, len(labels), _share(labels.sum(), len(labels)))]


def fit(texts: list[np.ndarray], labels: np.ndarray, hashes: np.ndarray | None = None, rank: int = RANK, epochs: int = 30, seed: int = 7) -> Model:
    """Adaptive gradient steps on the logistic loss; ``texts`` are the distinct term hashes of each row, ``hashes`` the terms to keep."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    hashes = terms_kept(texts, labels) if hashes is None else hashes
    share = _share(labels.sum(), len(labels))
    n = len(hashes)
    model = Model(hashes, 0.0, np.zeros(n), rng.normal(0, 0.05, (n, rank)))
    if not len(labels):
        model.bias = -np.inf
        return model
    row_of = np.repeat(np.arange(len(texts)), sizes)
    places, feature = model.known(every)
    row_of = row_of[places]
    begins = np.searchsorted(row_of, np.arange(len(texts) + 1))
    model.bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(n, 1e-2), np.full((n, rank), 1e-2), 1e-2
    rate, decay = 0.15, 5e-4
    order = rng.permutation(len(labels))
    apart, learn = order[: len(order) // 4], order[len(order) // 4 :]
    step = min(128, max(8, len(learn) // 24))
    for _ in range(max(epochs, STEPS * step // max(1, len(learn)))):
        for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // step)):
            length = begins[batch + 1] - begins[batch]
            at = np.repeat(begins[batch] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            f, r = feature[at], np.repeat(np.arange(len(batch)), length)
            slope = (1 / (1 + np.exp(-np.clip(model.logits(f, r, len(batch)), -30, 30))) - labels[batch]) / len(batch)
            used, inverse = np.unique(f, return_inverse=True)
            v = model.vectors[f]
            total = np.stack([np.bincount(r, v[:, k], len(batch)) for k in range(rank)], 1)
            dw = np.bincount(inverse, slope[r], len(used)) + decay / 8 * model.weights[used]
            g = slope[r][:, None] * (total[r] - v)
            dv = np.stack([np.bincount(inverse, g[:, k], len(used)) for k in range(rank)], 1) + decay * model.vectors[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += slope.sum() ** 2
            model.weights[used] -= rate * dw / np.sqrt(gw[used])
            model.vectors[used] -= rate / 4 * dv / np.sqrt(gv[used])
            model.bias -= rate * slope.sum() / np.sqrt(gb)
    own = np.flatnonzero(np.isin(row_of, apart))
    model.scale, model.shift = _calibrated(model.logits(feature[own], row_of[own], len(texts))[apart], labels[apart])
    return model


def _calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits by rows kept apart.

    The slope is that of a logistic fit (Platt's, with his smoothed targets),
    held between 1 and 5.  The shift puts the score THRESHOLD where the fewest
    of those rows fall on the wrong side, in the middle of the widest such gap.
    """
    positive = labels.sum()
    if not 0 < positive < len(labels):
        return 1.0, 0.0
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    x = np.stack([logits, np.ones(len(logits))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (p - target) + 0.05 * (theta - [1.0, 0.0]))
        theta -= np.clip(step, -1, 1)
    order = np.argsort(logits)
    ranked, wrong = logits[order], np.cumsum(labels[order] * 2 - 1)  # a cut above row k turns its label's side
    gaps = np.diff(ranked)
    costs = np.where(gaps > 1e-9, wrong[:-1], np.inf)
    best = np.flatnonzero(costs == costs.min())
    cut = best[np.argmax(gaps[best])]
    scale = float(np.clip(theta[0], 1, 5))
    return scale, float(np.log(THRESHOLD / (1 - THRESHOLD)) - scale * (ranked[cut] + ranked[cut + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), rows: int = TRAIN_ROWS) -> Model:
    """From labelled rows of ``docs`` whose id's remainder isn't the held-out one."""
    n, out = held_out
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), n) != out))
    sample = usable.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), F.col("doc_id").cast("string").alias("id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, r = _terms(part.column(0))
                bounds = np.searchsorted(r, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array([h[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()), part.column(1), part.column(2)], ["terms", "toxic", "id"])

    # Rows that repeat an id count once, so there are no more rows than the sample has.
    drawn = stored(texts.mapInArrow(features, "terms binary, toxic int, id string").groupBy("id", "toxic").agg(F.min("terms").alias("terms")), "terms")
    total = drawn.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).collect()[0]
    share = _share(total.toxic, total.n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                own = [np.frombuffer(t, np.uint64) for t in part.column(0).to_pylist()]
                h, which, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
                toxic = np.bincount(which, np.repeat(part.column(1).to_numpy(), [len(t) for t in own]), len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(toxic.astype(np.int64))], ["term", "docs", "toxic"])

    counted = drawn.select("terms", "toxic").mapInArrow(count, "term long, docs long, toxic long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    # Only terms that tell something reach the driver, and of each row only those.
    likely = counted.where((F.col("docs") >= LEAST_DOCS) & (F.abs(F.col("toxic") - F.col("docs") * share) >= LEAST_Z * F.sqrt(F.col("docs") * (share * (1 - share)))))
    kept = likely.toArrow()
    which = _telling(kept.column("docs").to_numpy(), kept.column("toxic").to_numpy(), total.n, share)
    hashes = np.sort(kept.column("term").to_numpy()[which].astype(np.int64).view(np.uint64))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(t, np.uint64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t[np.isin(t, hashes)].tobytes() for t in own], pa.binary()), batch.column(1), batch.column(2)], ["terms", "toxic", "id"])

    got = drawn.select("terms", "toxic", "id").mapInArrow(told, "terms binary, toxic int, id string").toArrow().to_pylist()
    got.sort(key=lambda x: (x["id"], x["toxic"]))
    return fit([np.frombuffer(x["terms"], np.uint64) for x in got], np.array([x["toxic"] for x in got], float), hashes)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with a column of scores, 0 to 1."""
    rest = docs.drop(into)
    held = docs.sparkSession.sparkContext.broadcast((model.hashes, model.bias, model.weights, model.vectors, model.scale, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                h, r = _terms(part.column(part.schema.get_field_index("text")))
                places, feature = own.known(h)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.scores(feature, r[places], part.num_rows))], names=[*part.schema.names, into])

    return rest.mapInArrow(run, rest.select("*", F.lit(None).cast("double").alias(into)).schema)


def op6_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
