"""Language identification as a multilingual mixture.

Training counts hashed letter trigrams for each language (all labelled rows; sums over partitions). A document's
words are taken as draws from a mixture of languages: expectation-maximisation over the words' trigram likelihoods
estimates the proportions. Language sets grow one by one in the order of the proportions, up to all languages; the set
with the largest log likelihood less the penalty (half the log of the number of words for each language, times a
factor) wins, and the prediction is its largest share. A document leaves the growth when the penalty alone, with every
word at its own maximum, keeps larger sets below the best one so far.

Defined results: ``und`` with score 0 for a null text, one without a letter, or when nothing was learned; rows
without text or language are not learned from; repeated rows count as often as they occur; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import thrifty, unused
from .tokens import pieces

BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 2.0
_letter: np.ndarray | None = None
_lower: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Letters of the basic plane and their lower case."""
    global _letter, _lower
    if _letter is None:
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(1 << 16)]
        _letter = np.array([c.isalpha() for c in chars])
        _lower = np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 1 << 16 else k for k, c in enumerate(chars)], np.uint32)
    return _letter, _lower


class Grams:
    """Hashed trigrams of the words (runs of letters, one space on either side) of a slice of texts."""

    def __init__(self, texts: list[str | None]):
        letter, lower = _tables()
        joined = " ".join([t or "" for t in texts])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(code, 0xFFFF)
        is_letter = letter[low] | (code > 0xFFFF) & np.array([False])
        if (code > 0xFFFF).any():
            far = np.flatnonzero(code > 0xFFFF)
            is_letter[far] = [chr(c).isalpha() for c in code[far]]
        folded = np.where(is_letter, np.where(code > 0xFFFF, code, lower[low]), 32).astype(np.uint32)
        padded = np.concatenate([[32], folded, [32]]).astype(np.uint32)
        inside = is_letter
        a, b, c = padded[:-2], padded[1:-1], padded[2:]
        h = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)).astype(np.uint32)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(inside)
        self.gram = ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1))[at].astype(np.int64)
        begins = np.flatnonzero(inside & (padded[:-2] == 32))
        self.word_first = np.searchsorted(at, begins)
        lengths = np.array([len(t or "") for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.first_gram = np.searchsorted(at, np.append(starts, len(code) + 1))
        self.first_word = np.searchsorted(begins, np.append(starts, len(code) + 1))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows with a text and a language; a task adds up what it reads before it sends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            grams = Grams(batch.column("text").to_pylist())
            sizes = np.diff(grams.first_gram)
            for lang in set(langs):
                mine = np.repeat(langs == lang, sizes)
                sums[lang] = sums.get(lang, 0) + np.bincount(grams.gram[mine], minlength=BUCKETS)
        for lang, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], ["lang", "bucket", "n"])

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").mapInArrow(thrifty(run), "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and the log probability of every bucket in each: ``BUCKETS`` numbers per language on the driver."""
    rows = count_grams(docs).toArrow().to_pandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows["bucket"].to_numpy(np.int64), [langs.index(x) for x in rows["lang"]]] = rows["n"]
    return langs, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)) if langs else counts


def _mixture(like: np.ndarray, owner: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document and its log likelihood (less the words' own maxima), over the allowed languages."""
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    filled = np.flatnonzero(np.diff(first))
    size = np.diff(first)[filled][:, None]
    score = np.zeros(len(allowed))
    for _ in range(rounds):
        part = like * share[owner]
        total = part.sum(1)
        share[filled] = np.add.reduceat(part / np.maximum(total, 1e-300)[:, None], first[filled], axis=0) / size
    total = (like * share[owner]).sum(1)
    score[filled] = np.add.reduceat(np.log(np.maximum(total, 1e-300)), first[filled])
    return share, score


def proportions(grams: Grams, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the selected languages (0 for others) of each document, and whether it has a letter."""
    n, k = len(grams.first_word) - 1, table.shape[1]
    words = np.diff(grams.first_word)
    if not len(grams.gram):
        return np.zeros((n, k)), words > 0
    like = np.add.reduceat(table[grams.gram], grams.word_first, axis=0)
    like = np.exp(np.maximum(like - like.max(1, keepdims=True), -30))
    owner = np.repeat(np.arange(n), words)
    share, _ = _mixture(like, owner, grams.first_word, np.ones((n, k)))
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, best_score = np.zeros((n, k)), np.full(n, -np.inf)
    cost = PENALTY * 0.5 * np.log(np.maximum(words, 2))
    for size in range(1, k + 1):
        open_ = best_score < -size * cost  # the log likelihood is never above 0
        if not open_.any():
            break
        first = np.concatenate([[0], np.cumsum(np.where(open_, words, 0))])
        first = np.append(first[:-1][open_], first[-1])
        mine = open_[owner]
        fitted, score = _mixture(like[mine], np.repeat(np.arange(open_.sum()), words[open_]), first, (rank[open_] < size).astype(float), ROUNDS if size > 1 else 0)
        score = score - size * cost[open_]
        better = score > best_score[open_]
        at = np.flatnonzero(open_)[better]
        best[at], best_score[at] = fitted[better], score[better]
    return best, words > 0


def _named(column: pa.Array, langs: list[str], table: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each text whether it has a letter (and something was learned), the language and the shares of its set."""
    grams = Grams(column.to_pylist())
    share, has_letter = proportions(grams, table) if langs else (np.zeros((len(column), 1)), np.zeros(len(column), bool))
    return has_letter, [langs[t] if ok else "und" for t, ok in zip(share.argmax(1), has_letter, strict=True)], share


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, lang_pred, score (its share) and langs, the selected set with shares."""
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, table.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = sent.value
        for batch in pieces(batches, "text__"):
            has_letter, pred, share = _named(batch.column("text__"), langs, table)
            score = np.where(has_letter, np.clip(share.max(1), 0, 1), 0.0)
            sets = [{langs[j]: float(row[j]) for j in np.flatnonzero(row > 0)} if ok else {} for row, ok in zip(share, has_letter, strict=True)]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score), pa.array([list(x.items()) for x in sets], pa.map_(pa.string(), pa.float64()))], [*keep, "lang_pred", "score", "langs"])

    rows = docs.select(*keep, F.col("text").alias("text__"))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string, score double, langs map<string,double>"])
    return rows.mapInArrow(thrifty(run), schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which a language is found, all columns; a missing ``lang`` is filled in.

    Only texts go to the Python workers; all other columns wait in the executor.
    """
    langs, table = fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast((langs, table.astype(np.float32)))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            whole = pa.RecordBatch.from_arrays([column], ["text"])
            found = [pa.array(_named(batch.column("text"), *sent.value)[1], pa.string()) for batch in pieces([whole], "text")]
            yield pa.concat_arrays(found) if found else pa.array([], pa.string())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    (pred,) = unused(docs, "lang_pred")
    # not deterministic for the planner: else it evaluates the function once for the filter and once more for the result
    found = docs.withColumn(pred, F.arrow_udf(thrifty(run), "string").asNondeterministic()(F.col("text").cast("string"))).where(F.col(pred) != "und")
    return found.select(*[F.coalesce(f"`{c}`", pred).alias(c) if c.lower() == "lang" else F.col(f"`{c}`") for c in docs.columns])
