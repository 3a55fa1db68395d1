"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct words (A-Z in lower case); with a ``width`` above 1 they are its windows of so many words (all
words where there are fewer). Lines are ordered by (doc_id, text, line number). Lines with equal token sets are a class, for
which the first line stands; a link joins two classes with a Jaccard similarity of at least ``threshold`` percent. Of a class
the first line stays; it goes too if it has a link to an earlier class.

1. All tokens are counted in ``SLOTS`` slots of their hash, a table of fixed size. Its counts, in steps of half a doubling,
   and then the hash give one order of all tokens, by rarity, whatever the size of the vocabulary.
2. Two similar sets share one of the first n - ceil(threshold * n) + 1 tokens in that order: the prefix of a set. Each
   class is posted under the codes of these tokens (level and 27 bits of the hash: two tokens with one code only make
   further candidates), with its size, the token's position and parity signs (each differing token flips one bit).
3. Classes that share a prefix code are candidates if the length filter, the positional filter and the signs, which bound the
   difference from below, allow the similarity; their full sets decide.

``linked_lines`` takes all links. ``duplicate_lines`` needs one earlier link of a class: each class first meets two earlier ones of
each of its ``LEADS`` lead keys, pairs of neighbouring prefix codes; those without a match go on to all other earlier ones. So a
large group of near copies costs about as many comparisons as it has lines there.

All steps are DataFrame operations. Defined results: a null text has no lines; lines without a word are never removed; rows that
repeat doc_id and text are treated alike; null doc_ids (and those that are no whole number) come first; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exact import SPACES, row_key, whole_id
from .store import shuffle_partitions, stash, unused

WIDTH = 5
SLOTS = 1 << 18
LEVELS, CODE_BITS = 32, 27
LEADS = 3
SIGNS = 4
SHORT = 96  # lines of up to so many tokens do without the further signs in their postings
LONG_SIGNS = tuple(f"sign{k}" for k in range(SIGNS))
BROADCAST_ROWS = 1_000_000
PLACE = ("doc_id", "row", "line_no")


def _small(x: Column) -> Column:
    """A-Z in lower case; a string with other than ASCII characters becomes one that stands for it alone."""
    # byte by byte, lower() also maps the lead bytes C3 to DE of two-byte characters, to bytes that lead longer ones only
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.lower(F.decode(x.cast("binary"), "ISO-8859-1")))


def _hashed(lines: DataFrame, width: int) -> DataFrame:
    """``line`` replaced by the hashes of its tokens; each line has a word."""
    line, rest = F.col("line"), [c for c in lines.columns if c != "line"]
    lines = lines.withColumn("line", _small(line))
    if width == 1:
        words = F.when(line.rlike(r"[\x09-\x0D]"), F.split(line, SPACES)).otherwise(F.split(line, " "))  # one plain character is not searched as a pattern
        return lines.select(*rest, words.alias("words")).select(*rest, F.array_remove(F.transform("words", lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))).alias("hashes"))
    lines = lines.select(*rest, F.array_remove(F.split(line, SPACES), "").alias("words"))
    lines = lines.withColumn("full", F.size("words") - width + 1)
    windows = F.transform(F.sequence(F.lit(0), F.greatest("full", F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(width)]))  # slice() copies the whole array
    return lines.select(*rest, F.when(F.col("full") > 0, windows).otherwise(F.array(F.xxhash64("words"))).alias("hashes"))


def token_sets(lines: DataFrame, width: int) -> DataFrame:
    """``line`` replaced by the sorted distinct hashes of its tokens."""
    return _hashed(lines, width).withColumn("tokens", F.sort_array(F.array_distinct("hashes"))).drop("hashes")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no, line of all lines with a word."""
    rows = docs.select(whole_id().alias("doc_id"), row_key().alias("row"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(_has_word(F.col("line")))


def _prefix_length(n: Column, threshold: int) -> Column:
    return n - F.floor((n.cast("long") * threshold + 99) / 100).cast("int") + 1


def rarity(docs: DataFrame, width: int) -> bytes:
    """The level of each slot, from 1: how often its tokens occur, in halves of a doubling. ``SLOTS`` rows reach the driver at most."""
    if width == 1:  # the words need not be told apart by lines, and plain rows are hashed faster than arrays
        words = docs.select(F.explode(F.split(F.col("text").cast("string"), SPACES)).alias("word")).where("word <> ''")
        hashes = words.select(F.xxhash64(_small(F.col("word"))).alias("h"))
    else:
        hashes = _hashed(_lines(docs).select("line"), width).select(F.explode("hashes").alias("h"))
    slots = hashes.select(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"))
    found = slots.groupBy("slot").agg(F.count("*").alias("n")).toArrow()
    levels = np.ones(SLOTS, np.uint8)
    if found.num_rows:
        n = found.column("n").to_numpy()
        levels[found.column("slot").to_numpy()] = np.clip(np.floor(2 * np.log2(n / np.median(n))) + 8, 0, LEVELS - 1) + 1
    return levels.tobytes()


def _keyed(lines: DataFrame, width: int) -> DataFrame:
    """doc_id, row, line_no, tokens and the key of the token set in two parts."""
    return token_sets(lines, width).withColumns({"k1": F.xxhash64("tokens"), "k2": F.xxhash64(F.lit(77), "tokens")})


def classes(docs: DataFrame, threshold: int, width: int = WIDTH) -> DataFrame:
    """sid (in the order of the first lines), k1, k2, first (its place), n, prefix, sign of each distinct token set."""
    levels = F.lit(rarity(docs, width))
    level = lambda h: F.ascii(F.substring(levels, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int") + 1, F.lit(1)).cast("string"))
    code = lambda h: (level(h) - 1 - LEVELS // 2) * F.lit(1 << CODE_BITS) + F.shiftrightunsigned(h, 8).bitwiseAND(F.lit((1 << CODE_BITS) - 1)).cast("int")
    flip = lambda sign, h: sign.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int")))
    n = F.size("tokens")
    prefix = F.slice(F.sort_array(F.transform("tokens", code)), F.lit(1), _prefix_length(n, threshold))
    more = [F.when(n > SHORT, _sign(k)).otherwise(0).alias(f"sign{k}") for k in range(SIGNS)]
    sets = _keyed(_lines(docs), width).select("k1", "k2", *PLACE, n.alias("n"), prefix.alias("prefix"), F.aggregate("tokens", F.lit(0).cast("long"), flip).alias("sign"), *more)
    place = F.struct(*PLACE)
    firsts = sets.groupBy("k1", "k2").agg(F.min_by(F.struct(place.alias("first"), "n", "prefix", "sign", *LONG_SIGNS), place).alias("x")).select("k1", "k2", "x.*")
    return stash(firsts.orderBy("first").withColumn("sid", F.monotonically_increasing_id()), "line-classes")


def _drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of queries that are done once the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _near_size(threshold: int, a: str = "_a") -> Column:
    """Length filter and signs of a class (with ``a`` in names) and another one (with _b)."""
    n, m, sign = F.col(f"n{a}"), F.col("n_b"), F.col(f"sign{a}")
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (F.bit_count(sign.bitwiseXOR(F.col("sign_b"))) * (100 + threshold) <= (100 - threshold) * (n + m))


def _allowed(threshold: int) -> Column:
    """The filters of classes, the positional filter and, of long lines, the further signs of two postings (with _a and _b in names)."""
    n, m = F.col("n_a"), F.col("n_b")
    room = (1 + F.least(n - F.abs("pos_a"), m - F.abs("pos_b"))) * (100 + threshold) >= threshold * (n + m)
    flipped = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in LONG_SIGNS), F.lit(0))
    near = (F.least(n, m) <= SHORT) | (flipped * (100 + threshold) <= (100 - threshold) * (n + m))
    return _near_size(threshold) & room & near


def _postings(sets: DataFrame) -> DataFrame:
    """code, sid, n, pos (from 1; below 0 for a class that is not open) and signs of each prefix token."""
    posted = sets.select("sid", F.col("n").cast("long").alias("n"), "sign", *LONG_SIGNS, "open", F.posexplode("prefix").alias("at", "code"))
    return posted.withColumn("pos", F.when(F.col("open"), F.col("at") + 1).otherwise(-1 - F.col("at"))).select("code", *POSTED)


POSTED = ("sid", "n", "pos", "sign", *LONG_SIGNS)


def _lead_pairs(sets: DataFrame, threshold: int) -> DataFrame:
    """Candidates (a, b): each class with the earliest and the last earlier one of each of its lead keys.

    A key is two neighbouring codes of the prefix, which unlike lines seldom share. Of those in its second half, where the tokens
    that only one copy has are few, the ``LEADS`` smallest hashes are taken: mostly the same ones in near copies.
    """
    size, at = F.size("prefix"), lambda i: F.get("prefix", i)
    keys = F.transform(F.sequence(F.floor((size - 1) / 2).cast("int"), F.greatest(size - 2, F.lit(0))), lambda i: F.xxhash64(at(i), at(i + 1)))
    facts = ("sid", "n", "sign")
    posted = sets.select("sid", F.col("n").cast("long").alias("n"), "sign", F.explode(F.slice(F.sort_array(F.array_distinct(keys)), 1, LEADS)).alias("key"))
    order = Window.partitionBy("key").orderBy("sid")
    leads = F.array(F.first(F.struct(*facts)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lag(F.struct(*facts)).over(order))
    pairs = posted.withColumn("leads", leads).select(*facts, F.explode("leads").alias("l")).select(*facts, *[F.col(f"l.{c}").alias(f"{c}_b") for c in facts])
    return pairs.where((F.col("sid") > F.col("sid_b")) & _near_size(threshold, "")).select(F.col("sid").alias("a"), F.col("sid_b").alias("b")).distinct()


def _all_pairs(sets: DataFrame, threshold: int) -> DataFrame:
    """Candidates (a, b): each open class with all earlier ones of its prefix codes. Both sides read one exchange."""
    # one exchange serves both sides only if these rename, use and filter the same columns: the condition on open classes names
    # both sides, and the one on sid keeps nulls from either
    left, right = (_postings(sets).select(*[F.col(c).alias(f"{c}_{x}") for c in ("code", *POSTED)]) for x in "ab")
    earlier = (F.col("sid_a") > F.col("sid_b")) & (F.when(F.col("pos_a") > 0, F.col("sid_a")).otherwise(-1) > F.col("sid_b"))
    pairs = left.join(right.hint("merge"), (F.col("code_a") == F.col("code_b")) & earlier & _allowed(threshold))
    return pairs.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct()


def _token_sets(docs: DataFrame, sets: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, tokens of the wanted classes, from their first lines."""
    wanted = stash(sets.select(F.col("sid").alias("id"), F.col("first.doc_id").alias("own"), F.col("first.row").alias("row"), F.col("first.line_no").alias("line_no")).join(ids.distinct(), "id"), "wanted-lines")
    n = wanted.count()
    if n <= BROADCAST_ROWS:  # only rows with a wanted line are cut into lines
        docs = docs.join(F.broadcast(wanted.select("row").distinct()), row_key() == F.col("row"), "left_semi")
    found = _lines(docs).join(_few(wanted, n), ["row", "line_no"]).where(F.col("doc_id").eqNullSafe(F.col("own"))).select("id", "line")
    return stash(token_sets(found, width).dropDuplicates(["id"]), "line-tokens")


def _sign(k: int) -> Column:
    """The k-th word of the parity signs of ``tokens``."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 52).bitwiseAND(F.lit(63)).cast("int"))
    mine = lambda h: F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(SIGNS - 1)) == k
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda sign, h: F.when(mine(h), sign.bitwiseXOR(bit(h))).otherwise(sign))


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, threshold: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold * union."""
    pairs = stash(pairs, "line-pairs")
    tokens = _token_sets(docs, sets, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), width)
    # longer signs than those of the postings spare most pairs the join with full sets
    signs = stash(tokens.select("id", F.size("tokens").cast("long").alias("n"), *[_sign(k).alias(f"s{k}") for k in range(SIGNS)]), "line-signs")
    few = signs.count()
    for c in ("a", "b"):
        pairs = pairs.join(_few(signs.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in signs.columns if x != "id"]), few), c)
    flipped = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(SIGNS)), F.lit(0))
    pairs = pairs.where(flipped * (100 + threshold) <= (100 - threshold) * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    for c in ("a", "b"):
        pairs = pairs.join(tokens.select(F.col("id").alias(c), F.col("tokens").alias(f"tokens_{c}")), c)
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - common
    return stash(pairs.where(common.cast("long") * 100 >= union.cast("long") * threshold).select("a", "b"), "line-links")


def near_matches(sets: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """sid of the classes with a link to an earlier one."""
    sets = sets.withColumn("open", F.lit(True))
    found = _verified(_lead_pairs(sets, threshold), docs, sets, threshold, width).select(F.col("a").alias("sid")).distinct()
    matched = found.withColumn("matched", F.lit(True))
    left = sets.select("sid", "n", "prefix", "sign", *LONG_SIGNS).join(_few(matched, matched.count()), "sid", "left").withColumn("open", F.col("matched").isNull()).drop("matched")
    pairs = _all_pairs(stash(left, "open-classes"), threshold)  # over a plain table both sides of the join read one exchange
    return found.unionByName(_verified(pairs, docs, sets, threshold, width).select(F.col("a").alias("sid")).distinct())


def linked_lines(docs: DataFrame, threshold: int = 80, width: int = WIDTH) -> DataFrame:
    """doc_id, row, line_no, first (the place of the class), n_links of all lines with a word: the whole join."""
    sets = classes(docs, threshold, width)
    links = _verified(_all_pairs(sets.withColumn("open", F.lit(True)), threshold), docs, sets, threshold, width)
    ends = links.select(F.col("a").alias("sid")).unionByName(links.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("n_links"))
    known = sets.select("k1", "k2", "sid", "first").join(ends, "sid", "left").select("k1", "k2", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return _members(docs, known, width)


def _members(docs: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """The place of all lines with what is known of their class; a large class is joined in parts."""
    lines = stash(_keyed(_lines(docs), width).drop("tokens"), "line-keys")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("row", "line_no"), F.lit(shuffle_partitions(docs.sparkSession))))
    parts = salted.select("k1", "k2", "salt").distinct().join(known, ["k1", "k2"])
    return salted.join(parts, ["k1", "k2", "salt"]).drop("k1", "k2", "salt")


def _marked(docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """k1, k2, first, near of each class."""
    sets = classes(docs, threshold, width)
    _drop_shuffles(docs.sparkSession)
    near = near_matches(sets, docs, threshold, width).withColumn("near", F.lit(True))
    return sets.select("k1", "k2", "sid", "first").join(near, "sid", "left").select("k1", "k2", "first", F.coalesce("near", F.lit(False)).alias("near"))


def duplicate_lines(docs: DataFrame, threshold: int = 80, width: int = WIDTH) -> DataFrame:
    """doc_id, row, line_no, exact, near of all lines with a word: why a line goes (both false: it stays)."""
    out = _members(docs, _marked(docs, threshold, width), width)
    exact = ~F.struct(*PLACE).eqNullSafe(F.col("first"))
    return out.select(*PLACE, exact.alias("exact"), (~exact & F.col("near")).alias("near"))


def _by_row(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """All rows: doc_id, n_lines (with a word) and the columns of ``counts`` (own, key and numbers; 0 where there is none)."""
    text = F.col("text").cast("string")
    n = F.coalesce(F.size(F.filter(F.split(text, "\n"), _has_word)), F.lit(0)).cast("long")
    rows = docs.select(whole_id().alias("doc_id"), row_key().alias("row"), F.when(text.isNull(), 0).otherwise(n).cast("long").alias("n_lines"))
    named = [c for c in counts.columns if c not in ("own", "key")]
    joined = rows.join(counts, (F.col("row") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("own")), "left")
    return joined.select("doc_id", "n_lines", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in named])


def deduplicate_lines(docs: DataFrame, threshold: int = 80, width: int = WIDTH) -> DataFrame:
    """doc_id, n_lines (with a word), n_exact, n_near, n_left of every row."""
    # a line is the first of its class or goes as an exact copy, so counts of the first lines of a row give all numbers
    firsts = _marked(docs, threshold, width).groupBy(F.col("first.doc_id").alias("own"), F.col("first.row").alias("key")).agg(F.count("*").alias("firsts"), F.count_if("near").alias("n_near"))
    rows = _by_row(docs, firsts)
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.col("firsts")).alias("n_exact"), "n_near", (F.col("firsts") - F.col("n_near")).alias("n_left"))


def cleaned(docs: DataFrame, threshold: int = 80, width: int = WIDTH) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``; all columns."""
    row, own, gone = unused(docs, "row_key", "own_id", "gone_lines")
    marks = duplicate_lines(docs, threshold, width).where("exact OR near").groupBy(F.col("row").alias("key"), F.col("doc_id").alias("of")).agg(F.collect_set("line_no").alias(gone))
    named = docs.withColumns({row: row_key(), own: whole_id()})
    named = named.join(marks, (named[row] == marks["key"]) & named[own].eqNullSafe(marks["of"]), "left").drop(marks["key"], marks["of"])
    kept = F.array_join(F.filter(F.split(named["text"], "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return named.withColumn("text", F.when(F.col(gone).isNull(), named["text"]).otherwise(kept)).select(*[f"`{c}`" for c in docs.columns])
