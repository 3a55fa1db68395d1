"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Each document is reduced once to a short vector of statistics of its bytes, words and lines. Cosines of random
projections of the standardised vector approximate a Gaussian kernel; every task sums its part of the normal
equations for each of ``FOLDS`` folds, the sums are added in two steps, and the driver solves systems of ``FEATURES``
unknowns: one over all folds, which scores, and one without each fold. The scores of a fold's rows by the system without them
are counted in bins and pooled into a monotone step function (pool adjacent violators), interpolated between the steps, that
turns scores into probabilities. So no row calibrates a fit that it took part in.

The fit uses at most about ``MAX_TRAIN`` labelled rows, taken by a hash of the doc_id; everything else covers all rows.

Defined results: a null text counts as empty and is scored like one; several labels of a document are averaged, null
labels ignored; without any usable label every score is 0.5; repeated rows are scored alike; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import SYMBOL, _lines
from .store import stash, thrifty
from .tokens import Words, mix, pieces, repeated, sums_by

FEATURES = 384
MAX_TRAIN = 500_000
RIDGE = 1e-3
BINS = 400
FOLDS = 4
SEED = 5


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LOW, DIGIT = (_class("".join(map(chr, range(ord(a), ord(b) + 1)))) for a, b in ("AZ", "az", "09"))
HIGH = np.arange(256) >= 128
STOP, COMMA, SHOUT = _class(".?"), _class(","), _class("!")
OTHER = _class("\"'()-/:;=@[\\]^_`{}~+")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    words = Words(column)
    lower = Words(column, lower=True)
    n, size = words.count.astype(float), np.diff(words.at).astype(float)
    n1, s1 = np.maximum(n, 1), np.maximum(size, 1)
    hashes, text = lower.hashes(), words.text_of_word()
    length = (words.end - words.start).astype(float)

    def byte_share(table: np.ndarray) -> np.ndarray:
        return sums_by(words.at, table[words.data].astype(np.int64)) / s1

    def word_share(mark: np.ndarray) -> np.ndarray:
        return sums_by(words.first, mark.astype(np.int64)) / n1

    key = mix(hashes + text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    firsts = np.zeros(len(key), bool)
    firsts[order[new]] = True
    distinct = word_share(firsts)
    runs = np.diff(np.append(np.flatnonzero(new), len(key)))
    most = np.zeros(words.texts)
    if len(key):
        np.maximum.at(most, text[order[new]], runs)
    shares = []
    for width in (2, 4, 8):
        windows, at = words.windows(hashes, width)
        mark = np.zeros(len(hashes), bool)
        mark[at[repeated(windows, text[at])]] = True
        shares.append(word_share(mark))
    lines, dups = _lines(words, text)
    last = lower.data[words.end - 1]
    letter_first = np.isin(lower.data[words.start], np.arange(97, 123)) | HIGH[lower.data[words.start]]
    mean = sums_by(words.first, length) / n1
    spread = np.sqrt(np.maximum(sums_by(words.first, length**2) / n1 - mean**2, 0))
    both = lambda a, b: byte_share(a) + byte_share(b)
    columns = [
        np.log1p(n), np.log1p(size), mean, spread, distinct, distinct * np.log1p(n), np.log1p(most) - np.log1p(n),
        byte_share(UPPER), byte_share(LOW), byte_share(DIGIT), byte_share(HIGH), byte_share(SYMBOL), byte_share(STOP), byte_share(COMMA), byte_share(SHOUT), byte_share(OTHER),
        word_share(length <= 3), word_share(length >= 12), word_share(length == 1), word_share(STOP[last]), word_share(letter_first), *shares,
        np.log1p(lines), dups / np.maximum(lines, 1), np.log1p(n / np.maximum(lines, 1)), both(UPPER, SHOUT),
    ]
    return np.sqrt(np.abs(np.stack(columns, 1))) * np.sign(np.stack(columns, 1))


def features(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys and ``stats``: all that the classifier knows of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text__"):
            stats = statistics(batch.column("text__"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1]), pa.int32()), pa.array(stats.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), flat], [*keys, "stats"])

    rows = docs.select(*keys, F.col("text").alias("text__"))
    return rows.mapInArrow(thrifty(run), ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["stats array<float>"]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Model:
    """Standardisation, projections, weights of the ridge regression and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.project + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.values)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing sequence nearest to the values."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else values


def solve(sums: np.ndarray) -> np.ndarray:
    """Ridge weights from normal equations, the targets in the last column; the bias, the last feature, is hardly shrunk."""
    size = len(sums)
    ridge = np.eye(size) * RIDGE * max(1.0, sums[-1, size - 1] / 1000)
    ridge[-1, -1] = 1e-9
    return np.linalg.solve(sums[:, :size] + ridge, sums[:, size])


def _summed(rows: DataFrame, part: callable, size: int) -> np.ndarray | None:
    """The sum over all rows of vectors of a fixed size: by partition, then by group of partitions, then on the driver."""

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = part(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("v"):
                x = np.frombuffer(x.as_py(), "<f8")
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    sums = rows.mapInArrow(by_partition, "v binary").repartition(8).mapInArrow(again, "v binary").collect()
    return np.sum([np.frombuffer(r.v, "<f8") for r in sums], axis=0) if sums else None


def fit(stats: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Model | None:
    """Learn from rows of ``stats`` (doc_id, stats) for which ``usable`` holds; None where there is no label."""
    marks = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    rows = stats.where(usable).select("doc_id", "stats").join(marks, "doc_id").withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)))
    rows = stash(rows, "train")
    n = rows.count()
    if not n:
        return None
    rows = rows.where(F.col("draw") < int(min(1.0, MAX_TRAIN / n) * 1_000_000))
    width = len(rows.first()["stats"])

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("stats"))
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    total = _summed(rows.select("stats"), moments, 2 * width + 1)
    mean = total[1 : width + 1] / total[0]
    scale = np.sqrt(np.maximum(total[width + 1 :] / total[0] - mean**2, 1e-6))
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(size=(width, FEATURES)) / np.sqrt(width), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    size = FEATURES + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((FOLDS, size, size + 1))
        for k in range(0, batch.num_rows, 4096):
            some = batch.slice(k, 4096)
            phi, y, fold = model.lift(_matrix(some.column("stats"))), some.column("y").to_numpy(), some.column("draw").to_numpy() % FOLDS
            for f in np.unique(fold):
                mine = phi[fold == f]
                out[f, :, :size] += mine.T @ mine
                out[f, :, size] += mine.T @ y[fold == f]
        return out.ravel()

    folds = _summed(rows.select("stats", "y", "draw"), normal, FOLDS * size * (size + 1)).reshape(FOLDS, size, size + 1)
    whole = folds.sum(0)
    model.weights = solve(whole)
    others = np.stack([solve(whole - f) for f in folds], 1)  # the weights that a fold is calibrated by

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        y, fold = batch.column("y").to_numpy(), batch.column("draw").to_numpy() % FOLDS
        raw = (model.lift(_matrix(batch.column("stats"))) @ others)[np.arange(len(y)), fold]
        at = np.clip(((raw + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    total = _summed(rows.select("stats", "y", "draw"), binned, 3 * BINS)
    count, good, raw = total.reshape(3, BINS)
    some = count > 0
    # half a row of either label keeps the ends off 0 and 1
    model.steps = raw[some] / count[some]
    share = isotonic(good[some] / count[some], count[some])
    model.values = (share * count.sum() + 0.5) / (count.sum() + 1)
    return model


def score(stats: DataFrame, model: Model | None, keys: tuple[str, ...]) -> DataFrame:
    """The keys and ``score``, the probability of label 1."""
    if model is None:
        return stats.select(*keys, F.lit(0.5).alias("score"))
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.score(_matrix(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(scores)], [*keys, "score"])

    rows = stats.select(*keys, "stats")
    return rows.mapInArrow(thrifty(run), ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["score double"]))
