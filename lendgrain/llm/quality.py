"""A learnt quality score from document statistics.

One pass turns every whole text into a row of statistics. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; ridge weights come from normal equations
whose sums each partition makes over its labelled rows and Spark adds up. A histogram of training
scores is then calibrated by isotonic regression, so a score is the share of good documents.

Fitting uses every labelled row outside the held-out fold; only sums of fixed size reach the
driver. Nulls and texts without words have statistics 0. Without labels of both kinds every score
is the training mean (0.5 if there is no label). Repeated rows are scored alike; ``docs`` may have
any other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm import words
from lendgrain.llm.frames import id_text, small_batches
from lendgrain.llm.labelled import held_out, training_labels, with_labels
from lendgrain.session import settle

FEATURES, RIDGE, BINS, SEED, THRESHOLD = 256, 1.0, 2000, 61, 0.3

SYMBOL, UPPER, DIGIT, STOP = (np.zeros(256) for _ in range(4))
SYMBOL[list(b"#*$%&|<>{}[]=~^\\_@")] = 1
STOP[list(b"!?.;:")] = 1
UPPER[65:91] = 1
DIGIT[48:58] = 1
HIGH = np.zeros(256)
HIGH[128:] = 1
N_STATISTICS = 14


def statistics(texts: words.Texts) -> np.ndarray:
    """One row per text: sizes and shares of kinds of characters, repeated words, pairs and lines."""
    n = len(texts)
    starts, ends = texts.words()
    owner = texts.owner(starts)
    hashed = texts.hashes(texts.running(), starts, ends)
    count = np.bincount(owner, minlength=n).astype(float)
    per_word = 1 / np.maximum(count, 1)
    size = np.diff(texts.edges).astype(float)
    per_byte = 1 / np.maximum(size, 1)
    length = ends - starts

    def share(table: np.ndarray, per: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[texts.data])))[texts.edges]
        return np.diff(total) * per

    def different(k: int) -> np.ndarray:
        h, at = (hashed, np.arange(len(hashed))) if k == 1 else words.sequences(hashed, owner, k)
        all_of = np.bincount(owner[at], minlength=n)
        return np.bincount(words.distinct(owner[at], h)[0], minlength=n) / np.maximum(all_of, 1)

    again = np.bincount(owner[1:][(hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    breaks = np.flatnonzero(texts.data == 10)
    lines = np.bincount(texts.owner(breaks), minlength=n)
    mean_length = np.bincount(owner, length, n) * per_word
    spread = np.sqrt(np.maximum(0, np.bincount(owner, length.astype(float) ** 2, n) * per_word - mean_length ** 2))
    return np.stack([
        np.log1p(count), np.minimum(mean_length, 50), np.minimum(spread, 50), np.minimum(share(SYMBOL, per_word), 5),
        np.minimum(share(STOP, per_word), 5), share(UPPER, per_byte), share(DIGIT, per_byte), share(HIGH, per_byte),
        different(1), different(2), different(3), again * per_word, np.minimum(lines * per_word, 1), np.log1p(size)], axis=1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    for piece, texts in words.cuts(batches):
        x = statistics(texts)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * N_STATISTICS
        yield words.table(schema, doc_id=piece.column("doc_id"), x=pa.ListArray.from_arrays(offsets, x.reshape(-1)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Fourier:
    """cos features of standardised statistics, the first one constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int):
        random = np.random.default_rng(seed)
        width = np.sqrt(len(mean))
        self.weights = random.normal(size=(len(mean), features)) / width / scale[:, None]
        self.phase = random.uniform(0, 2 * np.pi, features) - mean @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.weights + self.phase)
        return np.concatenate((np.ones((len(x), 1)), z), axis=1)


def isotonic(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising means closest to total / n, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for weight, good in zip(n, total):
        pools.append([weight, good, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.concatenate([np.full(int(k), good / weight) for weight, good, k in pools])


class Model:
    """Fourier features, ridge weights, and the calibration as points (raw score, share)."""

    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, points: np.ndarray, shares: np.ndarray):
        self.fourier, self.weights, self.points, self.shares = fourier, weights, points, shares

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), self.shares[0])
        return np.interp(self.raw(x), self.points, self.shares)


def _equations(fourier: Fourier):
    schema = pa.schema([("i", pa.int64()), ("row", pa.list_(pa.float64()))])

    def run(batches):
        total = 0
        for batch in batches:
            z, y = fourier(matrix(batch.column("x"))), batch.column("label").to_numpy().astype(float)
            total = total + z.T @ np.concatenate((z, y[:, None]), axis=1)
        if not np.isscalar(total):
            offsets = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
            yield words.table(schema, i=np.arange(len(total)), row=pa.ListArray.from_arrays(offsets, total.reshape(-1)))
    return run


def fit(known: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS, seed: int = SEED) -> Model:
    """Model from rows (x, label). The driver holds sums of ``features`` ** 2 and ``bins`` numbers."""
    n, good = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if n == 0 or good in (0, n):
        return Model(None, None, np.zeros(1), np.array([good / n if n else 0.5]))
    vector = array_to_vector("x")
    first = known.agg(Summarizer.mean(vector).alias("mean"), Summarizer.std(vector).alias("std")).first()
    scale = np.array(first["std"])
    fourier = Fourier(np.array(first["mean"]), np.where(scale > 0, scale, 1.0), features, seed)
    rows = known.mapInArrow(_equations(fourier), "i long, row array<double>").groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).orderBy("i").collect()
    sums = np.array([r["row"] for r in rows])
    penalty = np.eye(len(sums)) * ridge
    penalty[0, 0] = 0
    model = Model(fourier, np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1]), np.zeros(1), np.zeros(1))

    def binned(batches):
        schema = pa.schema([("bin", pa.int64()), ("n", pa.int64()), ("good", pa.int64())])
        for batch in batches:
            at = np.clip(np.floor((model.raw(matrix(batch.column("x"))) + 0.5) / 2 * bins), 0, bins - 1).astype(int)
            n, good = np.bincount(at, minlength=bins), np.bincount(at, batch.column("label").to_numpy(), bins)
            some = np.flatnonzero(n)
            yield words.table(schema, bin=some, n=n[some], good=good[some].astype(int))
    counts = known.mapInArrow(binned, "bin long, n long, good long").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    table = np.array([tuple(r) for r in counts], float)
    model.points = (table[:, 0] + 0.5) / bins * 2 - 0.5
    model.shares = isotonic(table[:, 1], table[:, 2])
    return model


def scores(docs: DataFrame, labels: DataFrame, target: str = "quality", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 from ``THRESHOLD`` on)."""
    stats = small_batches(settle(id_text(docs).mapInArrow(_statistics, "doc_id long, x array<double>")))
    model = fit(settle(with_labels(stats, training_labels(labels, target))).select("x", "label"), **options)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            yield words.table(schema, doc_id=batch.column("doc_id"), score=np.clip(model.score(matrix(batch.column("x"))), 0, 1))
    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
