"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A text's set holds the distinct windows of ``WIDTH`` words (all words where there are fewer), as 64-bit hashes. The
sketch has ``COORDINATES`` bins. In round i every element of the set is hashed to a bin and a value, and a bin keeps
the smallest (round, value); after COORDINATES random rounds further rounds place all elements in one bin each, in turn, so every bin is
filled whatever the size of the set. Bins agree with the probability of the Jaccard similarity, with the concentration
of independent trials. ``ROWS`` bins make a band; texts that agree in a band are candidates: two sets at similarity
0.85 meet in none of the 32 bands of 5 with a chance of 7e-9.

Equal sets are first reduced to one representative. In each bucket (texts that agree in a band) all members are
compared with a leader: the member with the most company over all its buckets, which stands in the middle of its group
and leads nearly all of the group's buckets. A pair goes to the full comparison only if sizes allow the similarity and the
parity signs of the sets (``SIGNS`` bits; each differing element flips one) do not already show too large a difference.
Linked texts are merged. Members of buckets in which several components are left then meet in an exact prefix join: their
tokens ordered by rarity, with length and positional filters and the same signs, inside tokens that are still held by several
components. So every candidate pair is either verified, cut off by an exact filter, or already known to be connected; a
group of n near copies costs about n comparisons.

A row is known by its doc_id and the hash of its doc_id and text, so ids may repeat. Defined results: null and blank texts
have an empty set and link with nothing; a null doc_id (or one that is no whole number) is never the smallest of its
component, and where all are null the component_id is null and the rows are kept; rows that repeat a doc_id are kept or not
like each other when their texts link; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact import row_key, whole_id
from .store import shuffle_partitions, stash, thrifty, unused
from .tokens import Words, mix, pieces

WIDTH = 5
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
SIGNS = 512
BROADCAST_IDS = 1_000_000


def shingles(column: pa.Array) -> list[np.ndarray]:
    """The sorted set of each text."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    windows, at = words.windows(hashes, WIDTH)
    first = np.searchsorted(at, words.first)
    out = []
    for k in range(words.texts):
        if words.count[k] >= WIDTH:
            out.append(np.unique(windows[first[k] : first[k + 1]]))
        elif words.count[k]:
            total = np.zeros(1, np.uint64)
            for h in hashes[words.first[k] : words.first[k + 1]]:
                total = mix(total * np.uint64(0xD6E8FEB86659FD93) + h)
            out.append(total)
        else:
            out.append(hashes[:0])
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, all sets round by round until each is full."""
    sizes = np.array([len(s) for s in sets])
    bins = np.full(len(sets) * t, np.iinfo(np.uint64).max)
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        h = mix(items ^ mix(np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        bin_ = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(items), i - t)
        value = (np.uint64(i) << np.uint64(54)) | (mix(h) >> np.uint64(10))
        np.minimum.at(bins, owner * t + bin_, value)
        full = (bins.reshape(-1, t).max(1) < np.iinfo(np.uint64).max) if len(sets) else np.zeros(0, bool)
        if full.all():
            break
        left = ~full[owner]
        if not left.all():
            items, owner = items[left], owner[left]
    return bins.reshape(-1, t)


def signs(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the parities of how many elements fall on each of ``SIGNS`` places, as 64-bit integers."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    at = owner * SIGNS + (mix(items) & np.uint64(SIGNS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=len(sets) * SIGNS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, SIGNS), axis=1).view(np.int64)


def _lists(rows: np.ndarray, some: list[int], n: int) -> pa.Array:
    """Lists of the rows at the places in ``some``, null elsewhere."""
    lists: list = [None] * n
    for k, row in zip(some, rows, strict=True):
        lists[k] = row
    return pa.array(lists, pa.list_(pa.int64()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sets = shingles(batch.column("text"))
        some = [k for k, s in enumerate(sets) if len(s)]
        filled = [sets[k] for k in some]
        sk = sketches(filled)
        keys = np.zeros((len(some), BANDS), np.uint64)
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + sk[:, r::ROWS] + np.uint64(r))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        parts = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists(keys.view(np.int64), some, len(sets)), _lists(signs(filled), some, len(sets))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *parts], ["row", "doc_id", "size", "digest", "bands", "signs"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("row"), whole_id().alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketch(docs: DataFrame) -> DataFrame:
    """row (the row's key), doc_id, size, digest of the set, the keys of its bands and its signs."""
    return _rows(docs).mapInArrow(thrifty(_sketch), "row long, doc_id long, size long, digest binary, bands array<long>, signs array<long>")


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def verify(pairs: DataFrame, texts: DataFrame, threshold: int, sets_of: Callable[[pa.Array], list[np.ndarray]] = shingles) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                a, b = some.column("a").to_pylist(), some.column("b").to_pylist()
                lefts = sets_of(some.column("text_a"))
                fresh = [i for i in range(len(b)) if (i == 0 or b[i] != b[i - 1]) and b[i] not in cache]
                rights = sets_of(some.column("text_b").take(pa.array(fresh, pa.int64())))
                if len(cache) > 64:
                    cache = {x: cache[x] for x in b if x in cache}
                cache.update({b[i]: s for i, s in zip(fresh, rights, strict=True)})
                good = []
                for i, s in enumerate(lefts):
                    o = cache[b[i]]
                    both = len(np.intersect1d(s, o, assume_unique=True))
                    good.append(100 * both >= threshold * (len(s) + len(o) - both))
                cache = {b[-1]: cache[b[-1]]}
                mask = pa.array(good)
                yield pa.RecordBatch.from_arrays([some.column("a").filter(mask), some.column("b").filter(mask)], ["a", "b"])

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(thrifty(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest member) of all ids in the links (a, b), by repeated hooking and contraction.

    In each round every node hooks to its smallest neighbour; two jumps shorten the chains, the links are renamed
    and loops dropped, until none is left. Nothing but a count reaches the driver.
    """
    links = stash(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = stash(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("component", F.col("id")), "labels")
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stash(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up")), "parents")
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        parent = stash(parent, "parents")
        rename = lambda df, c: df.join(parent.select(F.col("node").alias(c), F.col("up").alias("up_")), c, "left").withColumn(c, F.coalesce("up_", c)).drop("up_")  # noqa: E731, B023
        labels = stash(rename(labels, "component"), "labels")
        links = stash(rename(rename(links, "a"), "b").select("a", "b").where("a <> b").distinct(), "links")
    return labels


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _may_link(threshold: int) -> Column:
    """Sizes and signs allow the similarity: similar sets differ in at most (100 - t) / (100 + t) of both sizes' sum."""
    flipped = sum((F.bit_count(F.col("signs")[k].bitwiseXOR(F.col("signs_b")[k])) for k in range(SIGNS // 64)), F.lit(0))
    return (100 * F.least("size", "size_b") >= threshold * F.greatest("size", "size_b")) & (flipped * (100 + threshold) <= (100 - threshold) * (F.col("size") + F.col("size_b")))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sets = shingles(batch.column("text"))
        ids = np.repeat(batch.column("id").to_numpy(), [len(s) for s in sets])
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tokens.view(np.int64))], ["id", "token"])


def rare_pairs(members: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of members in different components that may be similar: an exact prefix filter.

    Tokens are ordered by rarity; similar sets share one in their prefixes. Copies that differ too much from all others
    have many tokens of their own, which come first and match nothing. ``members``: id, size, signs, component.
    """
    tokens = stash(texts.select("id", "text").mapInArrow(thrifty(_explode), "id long, token long"), "member-tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    mine = Window.partitionBy("id")
    place = F.row_number().over(mine.orderBy("df", "token")) - F.count("*").over(mine)
    known = tokens.join(shared, "token").withColumn("late", place).join(members.select("id", "size", "component"), "id").withColumn("pos", F.col("size") + F.col("late"))
    prefix = F.col("size") - F.ceil(F.col("size") * threshold / F.lit(100.0)) + 1
    postings = stash(known.where(F.col("pos") <= prefix).select("token", "id", "size", "component", "pos"), "member-prefixes")
    several = postings.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    mixed = postings.join(several, "token").join(members.select("id", "signs"), "id")
    other = mixed.select("token", *[F.col(c).alias(f"{c}_b") for c in ("size", "component", "pos", "signs")], F.col("id").alias("b"))
    room = (1 + F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b"))) * (100 + threshold) >= threshold * (F.col("size") + F.col("size_b"))
    pairs = mixed.join(other, "token").where((F.col("id") > F.col("b")) & (F.col("component") != F.col("component_b")) & room & _may_link(threshold))
    return pairs.select(F.col("id").alias("a"), "b").distinct()


def links(reps: DataFrame, docs: DataFrame, threshold: int = 85) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b) of representatives that span all components of the similarity graph, and the components.

    ``reps``: id, row, doc_id, size, bands, signs.
    """
    dealt = reps.select("id", "size", F.posexplode("bands").alias("band", "key")).select("id", "size", F.xxhash64("band", "key").alias("bucket"))
    company = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stash(dealt.join(company, "bucket"), "bucket-members")
    fame = members.groupBy("id").agg(F.sum("n").alias("fame"))
    known = stash(reps.select("id", "row", "doc_id", "size", "signs").join(fame, "id"), "known")
    leader = members.join(known.select("id", "fame"), "id").groupBy("bucket").agg(F.max_by("id", F.struct("fame", "id")).alias("b"))
    # a leader has more fame than those it leads, so no pair comes in both orders
    pairs = members.select("id", "bucket").join(leader, "bucket").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b").distinct()
    one, two = (known.select(F.col("id").alias(k), F.col("size").alias(f"size{x}"), F.col("signs").alias(f"signs{x}")) for k, x in (("a", ""), ("b", "_b")))
    pairs = stash(pairs.join(one, "a").join(two, "b").where(_may_link(threshold)).select("a", "b"), "pairs")
    found = stash(verify(pairs, _texts(docs, known, pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), threshold), "verified")
    labels = components(found)
    # of buckets with at least three members, those in which several components are left
    current = _labelled(members, labels)
    mixed = current.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("n > 2 AND low < high").select("bucket")
    open_ = current.join(mixed, "bucket").select("id", "component").distinct()
    open_ = stash(open_.join(known.select("id", "size", "signs"), "id"), "open")
    if not open_.limit(1).count():
        return found, labels
    texts = _texts(docs, known, open_.select("id"))
    more = stash(verify(stash(rare_pairs(open_, texts, threshold), "pairs"), texts, threshold), "verified")
    if not more.limit(1).count():
        return found, labels
    found = found.union(more)
    return found, components(found)


def _texts(docs: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the wanted representatives."""
    wanted = stash(known.select("id", "row", F.col("doc_id").alias("own")).join(ids.distinct(), "id"), "wanted")
    rows = _rows(docs).join(_hint(wanted, wanted.count()), "row").where(F.col("doc_id").eqNullSafe(F.col("own"))).select("id", "text")
    return stash(rows.dropDuplicates(["id"]), "pair-texts")


def representatives(sketched: DataFrame) -> DataFrame:
    """One row for each set: digest, row, doc_id, size, bands, signs and a number that stays with it."""
    chosen = F.min_by(F.struct("row", "doc_id", "size", "bands", "signs"), F.struct("row", "doc_id"))
    reps = sketched.where("digest IS NOT NULL").groupBy("digest").agg(chosen.alias("r")).select("digest", "r.*")
    return stash(reps.withColumn("id", F.monotonically_increasing_id()), "representatives")


def near_duplicates(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """row (the row's key), doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    sketched = stash(sketch(docs), "sketches")
    reps = representatives(sketched)
    _, labels = links(reps, docs, threshold)
    rows = sketched.select("row", "doc_id", "size", "digest").withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shuffle_partitions(spark))))
    parts = rows.where("digest IS NOT NULL").groupBy("digest", "salt").agg(F.min("doc_id").alias("low"))
    named = reps.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    classes = stash(parts.groupBy("digest").agg(F.min("low").alias("low")).join(named, "digest"), "classes")
    lowest = stash(classes.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    named = classes.join(lowest, "component").select("digest", "component_id")
    salted = parts.select("digest", "salt").join(named, "digest")
    out = rows.join(salted, ["digest", "salt"], "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("row", "doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns."""
    row, own = unused(docs, "row_key", "own_id")
    gone = near_duplicates(docs, threshold).where("NOT kept").select(F.col("row").alias(row), F.col("doc_id").alias(own)).distinct()
    gone = stash(gone, "gone")
    named = docs.withColumns({row: row_key(), own: whole_id()})
    same = [named[row] == gone[row], named[own].eqNullSafe(gone[own])]
    return named.join(_hint(gone, gone.count()), same, "left_anti").drop(row, own)
