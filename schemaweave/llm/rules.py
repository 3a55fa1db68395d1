"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document: the ledger holds the measurements and one bit per failed rule. A
policy is a versioned mask over these bits, so policies are applied and compared without reading a text again, and
ablations (what a policy drops only because of one rule) are counted by bitwise operations over the ledger.

Defined results: a null text has no words and fails the rules on length only; measurements of ratios are taken
against at least one word or character; rows are not merged, so repeated rows give repeated rows; other columns pass
by; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import thrifty
from .tokens import Words, pieces, repeated, sums_by

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_long_words long, n_letters long, n_stutters long"
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True
WINDOW, LONG_WORD = 8, 40


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails``, a SQL condition over the measurements, is true."""

    name: str
    fails: str


#: The order gives the bits; a new rule is appended, never inserted.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "20 * n_symbols > word_chars"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("giant_words", "10 * n_long_words > n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("no_words", "n_words = 0"),
    Rule("stutters", "10 * n_stutters > 3 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the decision: the names of the rules that drop a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
DEFAULT = Policy("keep-3", tuple(r.name for r in RULES))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"))
        hashes, text = words.hashes(), words.text_of_word()
        windows, at = words.windows(hashes, WINDOW)
        twice = at[repeated(windows, text[at])]
        cover = np.zeros(len(hashes) + 1, np.int64)
        cover[twice] += 1
        cover[twice + WINDOW] -= 1
        data, ends = words.data, words.at
        head = (data & 0xC0) != 0x80  # the first byte of a code point
        chars = np.concatenate([[0], np.cumsum(head)])
        lengths = chars[words.end] - chars[words.start]
        lines, dups = _lines(words, text)
        again = np.zeros(len(hashes), np.int64)  # words equal to the one before in the same text
        again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        columns = [words.count, sums_by(words.first, lengths), sums_by(ends, SYMBOL[data].astype(np.int64)), lines, dups, sums_by(words.first, (np.cumsum(cover)[:-1] > 0).astype(np.int64)), sums_by(words.first, (lengths > LONG_WORD).astype(np.int64)), sums_by(ends, (LETTER[data] & head).astype(np.int64)), sums_by(words.first, again)]
        keep = [(n, batch.column(n)) for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([c for _, c in keep] + [pa.array(np.asarray(c, np.int64)) for c in columns], [n for n, _ in keep] + [p.split()[0] for p in MEASURES.split(", ")])


def _lines(words: Words, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and how many of them equal an earlier one."""
    lines, dups = np.zeros(words.texts, np.int64), np.zeros(words.texts, np.int64)
    raw = words.data.tobytes()
    for k in np.flatnonzero(words.count):
        seen = [x for x in raw[words.at[k] : words.at[k + 1]].split(b"\n") if x and not x.isspace()]
        lines[k] = len(seen)
        dups[k] = len(seen) - len(set(seen))
    return lines, dups


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, the measurements and ``failed``, the bits of all rules a document fails."""
    source = docs.select(*keys, "text")
    schema = ", ".join([f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys] + [MEASURES])
    return source.mapInArrow(thrifty(_measure), schema).withColumn("failed", failure_bits())


def verdict(failed: Column, policy: Policy) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that only it drops."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    names = [r.name for r in RULES]
    sums = []
    for name in policy.rules:
        bit = 1 << names.index(name)
        sums += [F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias(f"fail_{name}"), F.count_if(hit == bit).alias(f"only_{name}")]
    one = rows.agg(F.count("*").alias("n"), F.count_if(hit != 0).alias("dropped"), *sums)
    entries = [F.struct(F.lit(policy.version).alias("policy"), F.lit(n).alias("rule"), "n", "dropped", F.col(f"fail_{n}").alias("failing"), F.col(f"only_{n}").alias("only_by_rule")) for n in policy.rules]
    return one.select(F.inline(F.array(*entries)))
