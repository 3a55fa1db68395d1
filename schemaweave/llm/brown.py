"""Language model scores from Brown's class bigrams.

Words are clustered in two steps. First the ``TOP`` most frequent words, one by one, and ``TAILS`` groups of equal endings
for all others are clustered by exchange: starting from classes by frequency, each type moves in turn to the class that
raises the average mutual information of adjacent classes the most. Then every other word that occurs at least ``SMALL``
times goes, by itself, to the class that makes the classes before and after it most likely; its counts of neighbouring
classes are added up over all training rows. Only words below ``SMALL`` and unseen ones keep the class of their group of
endings. The transitions are counted again over these final classes.

A text's probability is the product, over its words and an end token, of the probability of the word's class after the
class before it and of the word in its class. Class transitions are interpolated with the class frequencies; words inside
a group of endings are smoothed by absolute discounting, where the discounted mass goes to unseen words.

Counts cover all training rows. Words are known by their 64-bit hash. The counts and classes of the ``FREQUENT`` most frequent
words, a fixed number, are broadcast; all other tokens meet theirs in a join on the hash, and then the token before them
in the same text, so the vocabulary may outgrow any machine. Only pairs of seed types, at most (TOP + TAILS + 1)**2, pairs
of classes and the frequent words reach the driver.

Defined results: a null text is empty (one token, the end); with nothing to learn from, counts are 0 and the score is
the base score; repeated rows count as often as they occur; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stash, thrifty
from .tokens import Words, pieces, sums_by

TOP, TAILS, CLASSES = 1000, 1000, 64
FREQUENT = 1 << 18
SMALL = 3
SWEEPS = 6
HELD = 1 << 20  # tokens that a task holds before it adds them up
SHARE = 0.95
END = np.uint64(0x0123456789ABCDEF)


def _tail(words: Words) -> np.ndarray:
    """Group of each word's last three bytes (and whether it is short)."""
    data = np.concatenate([np.zeros(3, np.uint8), words.data]).astype(np.uint64)
    size = words.end - words.start
    last = [np.where(size > k, data[words.end + 2 - k], 0) for k in range(3)]
    code = (last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
    return ((code >> np.uint64(40)) % np.uint64(TAILS)).astype(np.int64)


def _sequence(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes and endings of all tokens, with an end token after each text, and the first token of each text."""
    stops = words.first[1:]
    first = words.first + np.arange(len(words.first))
    return np.insert(hashes, stops, END), np.insert(_tail(words), stops, -1), first


def count_words(docs: DataFrame) -> DataFrame:
    """hash, tail, n of all tokens of the training texts; each task adds up about a million words before it sends them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        tails: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, t = np.concatenate(kept), np.concatenate(tails)
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t[at].astype(np.int32)), pa.array(n)], ["hash", "tail", "n"])

        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), lower=True)
            h, t, _ = _sequence(words, words.hashes())
            kept.append(h)
            tails.append(t.astype(np.int16))
            size += len(h)
            if size > HELD:
                yield flush()
                kept, tails, size = [], [], 0
        if kept:
            yield flush()

    rows = docs.select("text").mapInArrow(thrifty(run), "hash long, tail int, n long")
    return rows.groupBy("hash").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Types:
    """Hashes (sorted) and counts of the frequent words; which of them are types of their own."""

    hashes: np.ndarray
    counts: np.ndarray
    own: np.ndarray  # number of the type, or -1
    tails: int  # type of the first group of endings

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash among the frequent words, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def types(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Types of the tokens: 0 the end, then words of their own, then groups of endings; and their positions."""
        at = self.find(h)
        own = np.where(at >= 0, self.own[at], -1) if len(self.own) else at
        return np.where(h == END, 0, np.where(own >= 0, own, self.tails + tail)), at


def count_pairs(docs: DataFrame, types: Types) -> DataFrame:
    """left, right, n: adjacent types in the training texts, the end token also standing before each text."""
    sent = docs.sparkSession.sparkContext.broadcast(types)
    total = types.tails + TAILS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total * total, np.int64)
        kept: list[np.ndarray] = []
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), lower=True)
            h, tail, _ = _sequence(words, words.hashes())
            kinds, _ = sent.value.types(h, tail)
            kept.append(np.concatenate([[0], kinds[:-1]]) * total + kinds)
            if sum(map(len, kept)) > HELD:
                sums += np.bincount(np.concatenate(kept), minlength=total * total)
                kept.clear()
        if kept:
            sums += np.bincount(np.concatenate(kept), minlength=total * total)
        at = np.flatnonzero(sums)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array((at // total).astype(np.int32)), pa.array((at % total).astype(np.int32)), pa.array(sums[at])], ["left", "right", "n"])

    return docs.select("text").mapInArrow(thrifty(run), "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, types: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the types by exchange clustering over the sparse counts of their pairs."""
    out_n, in_n = np.bincount(left, n, types), np.bincount(right, n, types)
    order = np.argsort(-in_n, kind="stable")
    of = np.zeros(types, np.int64)
    of[order] = np.minimum(np.arange(types), classes - 1) if types <= classes else np.arange(types) % classes
    g = np.zeros((classes, classes))
    np.add.at(g, (of[left], of[right]), n)
    rows, cols = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    row_at, col_at = np.searchsorted(left[rows], np.arange(types + 1)), np.searchsorted(right[cols], np.arange(types + 1))
    for _ in range(sweeps):
        moved = 0
        for t in order:
            if in_n[t] + out_n[t] == 0:
                continue
            r, c = rows[row_at[t] : row_at[t + 1]], cols[col_at[t] : col_at[t + 1]]
            own = n[r][right[r] == t].sum()
            after = np.bincount(of[right[r]], n[r], classes)
            before = np.bincount(of[left[c]], n[c], classes)
            was = of[t]
            after[was] -= own
            before[was] -= own
            g[was] -= after
            g[:, was] -= before
            g[was, was] -= own
            f = _xlogx(g)
            row_gain = (_xlogx(g + after) - f)
            col_gain = (_xlogx(g + before[:, None]) - f)
            d = np.arange(classes)
            gain = row_gain.sum(1) - row_gain[d, d] + col_gain.sum(0) - col_gain[d, d] + _xlogx(g[d, d] + after + before + own) - f[d, d]
            outs, ins = g.sum(1), g.sum(0)
            gain -= _xlogx(outs + out_n[t]) - _xlogx(outs) + _xlogx(ins + in_n[t]) - _xlogx(ins)
            best = int(np.argmax(gain))
            if gain[best] <= gain[was] + 1e-9:
                best = int(was)
            moved += best != was
            of[t] = best
            g[best] += after
            g[:, best] += before
            g[best, best] += own
        if moved <= types // 200:
            break
    return of


def count_contexts(docs: DataFrame, types: Types, of: np.ndarray) -> DataFrame:
    """hash, near, n: the classes before (near < CLASSES) and after (near - CLASSES) all words that are no seed type."""
    sent = docs.sparkSession.sparkContext.broadcast((types, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, of = sent.value
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, before, after = (np.concatenate(x) for x in zip(*kept, strict=True))
            h, at = np.unique(h, return_inverse=True)
            key, n = np.unique(np.concatenate([at * 2 * CLASSES + before, at * 2 * CLASSES + CLASSES + after]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[key // (2 * CLASSES)].view(np.int64)), pa.array((key % (2 * CLASSES)).astype(np.int32)), pa.array(n)], ["hash", "near", "n"])

        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), lower=True)
            h, tail, _ = _sequence(words, words.hashes())
            kinds, _ = types.types(h, tail)
            near = of[kinds].astype(np.int64)
            at = np.flatnonzero(kinds >= types.tails)
            if len(at):  # the end stands after the last word of each text, and before the first
                kept.append((h[at], np.where(at > 0, near[at - 1], near.dtype.type(of[0])), near[at + 1]))
                size += len(at)
            if size > HELD:
                yield flush()
                kept, size = [], 0
        if kept:
            yield flush()

    rows = docs.select("text").mapInArrow(thrifty(run), "hash long, near int, n long").repartition("hash")
    return rows.groupBy("hash", "near").agg(F.sum("n").alias("n"))


def assign(contexts: DataFrame, g: np.ndarray) -> DataFrame:
    """hash, class of the words seen ``SMALL`` times: the class that makes their neighbours' classes most likely.

    ``g``: counts of adjacent classes.
    """
    share = (g.sum(0) + 1) / (g.sum() + CLASSES)
    after, before = np.log((g + share) / (g.sum(1, keepdims=True) + 1)), np.log((g + share[:, None]) / (g.sum(0) + 1))
    table = np.where(g.sum(1) > 0, np.concatenate([before, after.T]), -1e6)  # near x class; none goes to an empty class
    sent = contexts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = batch.column("seen")
            first = seen.offsets.to_numpy()
            some = seen.values.slice(first[0], first[-1] - first[0])
            near, n = some.field("near").to_numpy(zero_copy_only=False), some.field("n").to_numpy(zero_copy_only=False)
            like = np.add.reduceat(table[near] * n[:, None], first[:-1] - first[0], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(like.argmax(1).astype(np.int32))], ["hash", "class"])

    # collect_list in the order of ``near`` keeps the sums of floats, and so ties, the same in every run
    lists = contexts.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("near", "n"))).alias("seen"), F.sum("n").alias("n"))
    return lists.where(F.col("n") >= 2 * SMALL).select("hash", "seen").mapInArrow(thrifty(run), "hash long, class int")


def count_steps(docs: DataFrame, types: Types, of: np.ndarray, vocabulary: DataFrame) -> np.ndarray:
    """Counts of adjacent final classes in the training texts."""
    sent = docs.sparkSession.sparkContext.broadcast((types, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, of = sent.value
        sums = np.zeros(CLASSES * CLASSES, np.int64)
        names = ["row_id", "pos", "hash", "tail", "before", "after", "n"]
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), lower=True)
            h, tail, first = _sequence(words, words.hashes())
            near, before, far = _near(h, *types.types(h, tail), of)
            both = np.flatnonzero((before >= 0) & (near >= 0))
            sums += np.bincount(before[both] * CLASSES + near[both], minlength=CLASSES * CLASSES)
            owner = np.repeat(batch.column("row_id").to_numpy(), np.diff(first))[far]
            parts = [pa.array(owner), pa.array(far), pa.array(h[far].view(np.int64)), pa.array(tail[far].astype(np.int32)), pa.array(before[far].astype(np.int32)), pa.array(near[far + 1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*parts, pa.nulls(len(far), pa.int64())], names)
        at = np.flatnonzero(sums)
        none = lambda t: pa.nulls(len(at), t)
        yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int32()), pa.array((at // CLASSES).astype(np.int32)), pa.array((at % CLASSES).astype(np.int32)), pa.array(sums[at])], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "text")
    parts = stash(rows.mapInArrow(thrifty(run), "row_id long, pos long, hash long, tail int, before int, after int, n long"), "steps")
    near = placed(parts.where("hash IS NOT NULL"), vocabulary, types, of)
    far = near.select(F.explode(F.array(F.struct(F.col("before").alias("left"), F.col("class").alias("right")), F.struct(F.col("class").alias("left"), F.col("after").alias("right")))).alias("p"))
    far = far.select("p.left", "p.right", F.lit(1).cast("long").alias("n")).where("right >= 0")
    pairs = parts.where("hash IS NULL").select(F.col("before").alias("left"), F.col("after").alias("right"), "n").unionByName(far)
    found = pairs.groupBy("left", "right").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    g = np.zeros((CLASSES, CLASSES))
    g[found["left"], found["right"]] = found["n"]
    return g


def _near(h: np.ndarray, kinds: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The final class of each token and of the token before it, -1 where only the join knows it; the tokens to join."""
    far = (at < 0) & (h != END)
    near = np.where(far, -1, of[kinds]).astype(np.int64)
    return near, np.concatenate([[of[0]], near[:-1]]), np.flatnonzero(far)


def placed(rare: DataFrame, vocabulary: DataFrame, types: Types, of: np.ndarray) -> DataFrame:
    """``rare`` with own (the word is clustered by itself), n, class, and in ``before`` the class before it."""
    tails = rare.sparkSession.createDataFrame([(k, int(of[types.tails + k])) for k in range(TAILS)], "tail int, tail_class int")
    known = rare.drop("n").join(vocabulary.select("hash", "n", F.col("class").alias("own_class")), "hash", "left")
    # one row for each of a fixed number of groups
    known = known.join(F.broadcast(tails), "tail").withColumn("class", F.coalesce("own_class", "tail_class"))
    last = F.lag("class").over(Window.partitionBy("row_id").orderBy("pos"))
    return known.withColumn("last", last).select("*", F.when(F.col("before") < 0, F.col("last")).otherwise(F.col("before")).alias("prior")).drop("before", "last", "tail_class").withColumnRenamed("prior", "before")


@dataclass
class Model:
    """All that scoring needs beside the counts and classes of rare words."""

    types: Types
    classes: np.ndarray
    step: np.ndarray  # log10 of class after class
    emit: np.ndarray  # log10 of type in its class
    joined_n: np.ndarray  # tokens of each class in words that are clustered but not among the frequent ones
    tail_n: np.ndarray  # tokens in each group of endings
    discount: float
    unseen: np.ndarray  # log10 of one unseen word in its group of endings
    n: int
    v: int


def frequent(counts: DataFrame) -> DataFrame:
    """At most ``FREQUENT`` words: all above the lowest step of a logarithmic histogram of counts that keeps the bound."""
    words = counts.where(F.col("hash") != int(END.view(np.int64))).withColumn("step", F.floor(F.log2("n") * 64).cast("long"))
    steps = words.groupBy("step").count().orderBy(F.desc("step")).collect()  # 64 for each doubling
    upto = np.cumsum([r["count"] for r in steps])
    fits = int((upto <= FREQUENT).sum())
    return words.where(F.col("step") >= (steps[fits - 1]["step"] if fits else 1 << 40)).select("hash", "n")


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of all words' counts and classes (hash, tail, n, class)."""
    counts = stash(count_words(docs), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts).toArrow().to_pandas().sort_values(["n", "hash"], ascending=[False, True])
    h, n = top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    seeds = Types(h[order], n[order], np.where(order < TOP, 1 + order, -1), 1 + TOP)
    size = 1 + TOP + TAILS
    pairs = count_pairs(docs, seeds).toArrow().to_pandas()
    left, right, seen = (pairs[c].to_numpy(np.int64) for c in ("left", "right", "n"))
    seed_of = exchange(left, right, seen.astype(float), size)
    g = np.zeros((CLASSES, CLASSES))
    np.add.at(g, (seed_of[left], seed_of[right]), seen)
    vocabulary = stash(counts.join(assign(count_contexts(docs, seeds, seed_of), g), "hash", "left"), "word-classes")

    placed_ = vocabulary.where("class IS NOT NULL")
    found = placed_.join(frequent(counts).select("hash"), "hash").select("hash", "class").toArrow().to_pandas()
    class_of = np.full(len(h), -1)
    class_of[np.searchsorted(seeds.hashes, found["hash"].to_numpy(np.int64).view(np.uint64))] = found["class"]
    seeded = order < TOP
    class_of[seeded] = seed_of[1 + order[seeded]]
    single = class_of >= 0
    k = int(single.sum())
    own = np.where(single, np.cumsum(single), -1)
    types = Types(seeds.hashes, seeds.counts, own, 1 + k + CLASSES)  # the end, own words, joined words of each class, endings
    of = np.concatenate([seed_of[:1], class_of[single], np.arange(CLASSES), seed_of[1 + TOP :]])
    g = count_steps(docs, types, of, vocabulary)
    joined_n = np.zeros(CLASSES)
    sums = placed_.groupBy("class").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    joined_n[sums["class"]] = sums["n"]
    joined_n -= np.bincount(class_of[single & ~seeded], seeds.counts[single & ~seeded], CLASSES)
    chosen = set(h[:TOP].tolist())
    rare = counts.where(~F.col("hash").isin([int(x) for x in np.array(sorted(chosen), np.uint64).view(np.int64)])) if chosen else counts
    tails = rare.where((F.col("tail") >= 0) & (F.col("n") < SMALL)).groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).toArrow().to_pandas()
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    tail_n[tails["tail"]], tail_v[tails["tail"]] = tails["n"], tails["v"]
    one, two = float(tails["one"].sum()), float(tails["two"].sum())
    discount = min(0.95, max(0.05, one / max(one + 2 * two, 1)))
    # a group without training words is taken to have as many unseen ones as an average group has words
    unseen = np.log10(np.where(tail_n > 0, discount * tail_v / np.maximum(tail_n, 1) / (tail_v + 1), 1 / (max(1.0, tail_v.mean()) + 1)))
    ends = counts.where(F.col("hash") == int(END.view(np.int64))).first()
    type_n = np.concatenate([[ends.n if ends else 0], seeds.counts[single], joined_n, tail_n]).astype(float)
    class_n = np.bincount(of, type_n, CLASSES)
    base = (class_n + 1) / (class_n.sum() + CLASSES)
    step = SHARE * (g + base) / (g.sum(1, keepdims=True) + 1) + (1 - SHARE) * base
    emit = (type_n + 0.5) / (class_n[of] + 0.5 * np.bincount(of, minlength=CLASSES)[of])
    return Model(types, of, np.log10(step), np.log10(emit), joined_n, tail_n, discount, unseen, int(total.n), int(total.v)), vocabulary


PARTIAL = "row_id long, n_tokens long, n_known long, base double, score double, pos long, hash long, tail int, before int, after int"


def score(docs: DataFrame, model: Model, counts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    whole = np.log10(model.n + model.v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        base_of = np.log10(m.types.counts + 1.0) - whole
        named = [*keys, *(x.split()[0] for x in PARTIAL.split(", "))]
        for batch in pieces(batches, "text__"):
            words = Words(batch.column("text__"), lower=True)
            h, tail, first = _sequence(words, words.hashes())
            kind, at = m.types.types(h, tail)
            of, before, far = _near(h, kind, at, m.classes)
            logp = np.where(of >= 0, m.emit[kind] + np.where(before >= 0, m.step[before, of], 0.0), 0.0)
            known, ends = at >= 0, h == END
            in_tail = known & (kind >= m.types.tails)
            if in_tail.any():
                logp[in_tail] += np.log10((m.types.counts[at[in_tail]] - m.discount) / m.tail_n[tail[in_tail]])
            base = np.zeros(len(h))
            base[known] = base_of[at[known]]
            base[ends] = np.log10(end_count + 1) - whole
            rows = words.texts
            ids = batch.column("row_id").to_numpy()
            sums = [words.count + 1, sums_by(first, (known | (ends & (end_count > 0))).astype(np.int64)), sums_by(first, base), sums_by(first, logp)]
            owner = np.repeat(np.arange(rows), np.diff(first))[far]
            k = len(far)
            none = lambda n, t: pa.nulls(n, t)
            parts = [pa.concat_arrays([batch.column(c), none(k, batch.column(c).type)]) for c in keys]
            parts.append(pa.array(np.concatenate([ids, ids[owner]])))
            for values in sums:
                values = pa.array(values)
                parts.append(pa.concat_arrays([values, none(k, values.type)]))
            for values in (pa.array(far), pa.array(h[far].view(np.int64)), pa.array(tail[far].astype(np.int32)), pa.array(before[far].astype(np.int32)), pa.array(of[far + 1].astype(np.int32))):
                parts.append(pa.concat_arrays([none(rows, values.type), values]))
            yield pa.RecordBatch.from_arrays(parts, named)

    end = counts.where(F.col("hash") == int(END.view(np.int64))).first()
    end_count = int(end.n) if end else 0
    rows = docs.select(*keys, F.monotonically_increasing_id().alias("row_id"), F.col("text").alias("text__"))
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [PARTIAL])
    parts = stash(rows.mapInArrow(thrifty(run), schema), "word-scores")
    if model.n == 0:
        model_score = F.col("base_score")
    else:
        model_score = F.col("model")
    first_tail = model.types.tails
    tails = spark.createDataFrame([(k, float(model.tail_n[k]), float(model.unseen[k]), float(model.emit[first_tail + k])) for k in range(TAILS)], "tail int, tail_n double, unseen double, tail_emit double")
    lumps = spark.createDataFrame([(c, float(model.emit[first_tail - CLASSES + c] - np.log10(max(model.joined_n[c], 1)))) for c in range(CLASSES)], "class int, own_emit double")
    steps = spark.createDataFrame([(i, j, float(model.step[i, j])) for i in range(CLASSES) for j in range(CLASSES)], "before int, class int, into double")
    onward = steps.select(F.col("before").alias("class"), F.col("class").alias("after"), F.col("into").alias("out_of"))
    rare = parts.where("hash IS NOT NULL").select("row_id", "pos", "hash", "tail", "before", "after")
    rare = placed(rare.withColumn("n", F.lit(None)), counts, model.types, model.classes)
    # one row for each of a fixed number of groups, classes or pairs of classes
    rare = rare.join(F.broadcast(tails), "tail").join(F.broadcast(lumps), "class").join(F.broadcast(steps), ["before", "class"]).join(F.broadcast(onward), ["class", "after"], "left")
    in_group = F.when(F.col("n").isNull(), F.col("unseen")).otherwise(F.log10((F.col("n") - F.lit(model.discount)) / F.col("tail_n")))
    emitted = F.when(F.col("own_class").isNull(), F.col("tail_emit") + in_group).otherwise(F.col("own_emit") + F.log10("n"))
    rare = rare.select(
        "row_id",
        F.lit(None).cast("long").alias("n_tokens"),
        F.col("n").isNotNull().cast("long").alias("n_known"),
        (F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(1.0)) - F.lit(float(whole))).alias("base"),
        (emitted + F.col("into") + F.coalesce("out_of", F.lit(0.0))).alias("score"),
    )
    some = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys]
    mine = parts.where("hash IS NULL").select(*keys, "row_id", "n_tokens", "n_known", "base", "score")
    summed = mine.unionByName(rare.select(*some, "row_id", "n_tokens", "n_known", "base", "score")).groupBy("row_id").agg(
        *[F.max(k).alias(k) for k in keys], F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("model")
    )
    return summed.select(*keys, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", model_score.alias("score"))
