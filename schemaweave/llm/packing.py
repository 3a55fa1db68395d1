"""Packing of tokenised documents into sequences: vector bin packing by the dot-product heuristic.

Every sequence has three capacities: tokens, segments and loss-bearing tokens. An open sequence takes, of the pending
pieces that fit, the one whose demand has the largest dot product with what is left of the capacities (both as shares
of the limits). When none fits whole, the longest pending piece is cut at the space left, so sequences come out full.
What remains at the end of a task is cut into sequences whose lengths are powers of two, which need no padding.

Each task packs the documents of its input partition as they stream past and holds at most ``POOL`` pending
pieces, so nothing is shuffled and no task sees a whole source. A lost task is repeated with the same input and gives
the same sequences: their ids are the partition's number times 2**40 plus a running number.

Defined results: a null or empty text is the end token alone; repeated rows are packed as often as they occur; a null
doc_id stays null, one that is no whole number becomes null; other columns are ignored; an empty table gives no rows. ``prompt_tokens``, where given, counts the
leading ids of a document that carry no loss (null: 0).
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import thrifty
from .tokens import Words, pieces

POOL = 512
SLICE = 1 << 19  # bytes of text that are encoded at once
CACHE = 14 << 20  # bytes of each half of the cache of words in a worker
PART_CACHE = 6 << 20  # the same for parts of words, as estimated from keys and values
ENTRY = 150  # bytes of an entry there besides its key and value
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIMPLE = re.compile(f"[\x21-\x7e{LATIN}]*")
#: The normalisation and splitting of the vocabulary file: fixed values. Files with others go through the library alone.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: The same splitting for lines of lower-case ASCII and Latin letters; a line break is a part of its own.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|\n|[^a-z0-9\n{LATIN}]+")
ODD = re.compile(f"[^\n\x21-\x7e{LATIN}]")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048


def _byte_names() -> list[str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, all others from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Recent:
    """A cache of bounded size in two halves: what is used of the older half moves to the newer one, the rest goes."""

    def __init__(self, most: int = PART_CACHE):
        self.most, self.size = most, 0
        self.new: dict = {}
        self.old: dict = {}

    def refresh(self, wanted: set) -> set:
        """Moves what is known of ``wanted`` to the newer half; the rest is returned."""
        lost = wanted.difference(self.new)
        if self.old and (moved := lost.intersection(self.old)):
            self.new.update(zip(moved, map(self.old.__getitem__, moved), strict=True))
            self.size += len(moved) * (ENTRY + 16)
            lost -= moved
        return lost

    def add(self, found: dict) -> None:
        self.new.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + len(found) * ENTRY

    def turn(self) -> None:
        """Start a new half when the newer one is full."""
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every stretch, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Half:
    """Token ids of words in flat arrays: sorted hashes, and where the ids of each lie in one pool."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1024, "<u4"), 0

    def __len__(self) -> int:
        return len(self.keys)

    @property
    def size(self) -> int:
        return 20 * len(self.keys) + 4 * len(self.pool)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys and which of them are here."""
        place = np.searchsorted(self.keys, keys)
        here = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        here[inside] = self.keys[place[inside]] == keys[inside]
        return place, here

    def take(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids the entries have, and all their ids."""
        count = self.count[place]
        return count, self.pool[spread(self.at[place], count)]

    def add(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Entries with ascending keys that are not here yet."""
        if (more := self.used + len(ids)) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(more - self.used + more // 3, "<u4")])
        self.pool[self.used : more] = ids
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, place, count)
        self.used = more


class Shelf:
    """Words known by their 64-bit hashes, in two halves as in ``Recent``: some 30 bytes a word and no Python objects."""

    def __init__(self, most: int = CACHE):
        self.most, self.new, self.old = most, Half(), Half()

    def refresh(self, keys: np.ndarray) -> np.ndarray:
        """Moves what is known of the ascending keys to the newer half; returns which are unknown."""
        lost = ~self.new.find(keys)[1]
        if len(self.old) and lost.any():
            place, here = self.old.find(keys)
            moved = lost & here
            self.new.add(keys[moved], *self.old.take(place[moved]))
            lost &= ~here
        return lost

    def turn(self) -> None:
        if self.new.size > self.most:
            self.old, self.new = self.new, Half()


class WordTokenizer:
    """Encodes texts word by word with caches; equal to encoding the whole text, as no token spans white space.

    The distinct words of a slice are found and looked up by their 64-bit hashes (see ``tokens``) in flat arrays.

    Words of printable ASCII and Latin letters are split here and go straight to the merges; the vocabulary's own
    normalisation and splitting are applied to all others. A vocabulary file that normalises or splits in another way than
    ``NORMALIZER`` and ``SPLITTER`` gets whole texts through the library.
    """

    loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merge = self.model.model.tokenize
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.by_word = (said["normalizer"], said["pre_tokenizer"]) == (NORMALIZER, SPLITTER) and not said["post_processor"]
        self.names = dict(enumerate(_byte_names()))
        self.words, self.parts = Shelf(), Recent()

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        """One for each worker process, so that tasks share the caches."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _merged(self, part: str) -> bytes:
        ids = [t.id for t in self.merge(part if part.isascii() else part.encode().decode("latin-1").translate(self.names))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _simple(self, lows: str) -> tuple[np.ndarray, bytes]:
        """Number of ids of each lower-case word, one a line, and all ids."""
        flat = PARTS.findall(lows + "\n")
        wanted = set(flat)
        wanted.discard("\n")
        self.parts.add({part: self._merged(part) for part in self.parts.refresh(wanted)})
        get = self.parts.new.get
        ids = [get(part, b"") for part in flat]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        breaks = np.flatnonzero(np.fromiter(map("\n".__eq__, flat), bool, len(flat)))
        return np.diff(ends[breaks], prepend=0) // 4, b"".join(ids)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in the words' order."""
        text = b"\n".join(words).decode()  # words hold no line break
        low = text.lower()
        if not (ODD.search(text) or ODD.search(low) or "<|" in text):
            count, ids = self._simple(low)
            return count, np.frombuffer(ids, "<u4")
        texts = text.split("\n")
        plain = [not ODD.search(t) and not ODD.search(t.lower()) and "<|" not in t for t in texts]
        found: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        simple = [k for k, p in enumerate(plain) if p]
        if simple:
            count, ids = self._simple("\n".join([texts[k].lower() for k in simple]))
            for k, own in zip(simple, np.split(np.frombuffer(ids, "<u4"), np.cumsum(count)[:-1]), strict=True):
                found[k] = own
        other = [k for k, p in enumerate(plain) if not p]
        for k, e in zip(other, self.model.encode_batch_fast([texts[k] for k in other], add_special_tokens=False), strict=True):
            found[k] = np.asarray(e.ids, "<u4")
        return np.array(list(map(len, found)), np.int64), np.concatenate(found)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_word:
            for text in texts:
                yield np.asarray(self.model.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            return
        self.words.turn()
        self.parts.turn()
        words = Words(pa.array(texts, pa.binary()))
        keys, first, kind = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if (lost := self.words.refresh(keys)).any():
            raw, first = words.data.tobytes(), first[lost]
            self.words.new.add(keys[lost], *self.learn([raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]))
        count, ids = self.words.new.take(self.words.new.find(keys)[0][kind])
        ends = np.concatenate([[0], np.cumsum(count)])[words.first].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield ids[a:b].tobytes()


class Packer:
    """Packs (key, ids, prompt) as they come; ``out`` gets (key, start, length, crc, total, sequence, offset, ids)."""

    def __init__(self, limits: Limits, first_sequence: int = 0, emit_ids: bool = False):
        self.limits, self.sequence, self.emit_ids = limits, first_sequence, emit_ids
        self.out: list[tuple] = []
        self.items: list[tuple] = []  # (key, start, stop, ids, prompt)
        self.need = np.zeros((2, POOL + 1))  # tokens and loss tokens of the pending items
        self.placed: list[tuple] = []

    @staticmethod
    def _loss(start: int, stop: int, prompt: int) -> int:
        return max(0, stop - max(start, prompt))

    def add(self, key, ids: bytes, prompt: int = 0) -> None:
        stop, start, full = len(ids) // 4, 0, min(self.limits.tokens, self.limits.loss_tokens)
        while stop - start >= self.limits.tokens and self._loss(start, start + self.limits.tokens, prompt) <= self.limits.loss_tokens:
            self._emit([(key, start, start + self.limits.tokens, ids, prompt)])
            start += self.limits.tokens
        while stop - start > full:  # under a tighter loss limit
            self._pend((key, start, start + full, ids, prompt))
            start += full
        if stop > start:
            self._pend((key, start, stop, ids, prompt))

    def _pend(self, item: tuple) -> None:
        k = len(self.items)
        self.items.append(item)
        self.need[:, k] = item[2] - item[1], self._loss(item[1], item[2], item[4])
        if len(self.items) > POOL:
            self._fill()

    def _take(self, k: int) -> tuple:
        item, last = self.items[k], len(self.items) - 1
        self.items[k] = self.items[last]
        self.need[:, k] = self.need[:, last]
        self.items.pop()
        return item

    def _fill(self) -> None:
        """Build one sequence from the pending items."""
        top = np.array([self.limits.tokens, self.limits.loss_tokens], float)
        left, segments, placed = top.copy(), self.limits.segments, []
        while left[0] > 0 and segments > 0 and self.items:
            need = self.need[:, : len(self.items)]
            # the last segment has to fill what is left
            fits = (need[0] <= left[0]) & (need[1] <= left[1]) & ((segments > 1) | (need[0] == left[0]))
            if fits.any():
                gain = (need[0] / top[0]) * (left[0] / top[0]) + (need[1] / top[1]) * (left[1] / top[1]) + segments / self.limits.segments / self.limits.segments
                item = self._take(int(np.argmax(np.where(fits, gain, -1.0))))
            else:
                key, start, stop, ids, prompt = self._take(int(np.argmax(need[0])))
                cut = start + int(min(stop - start, left[0], max(0, prompt - start) + left[1]))
                if cut < stop:
                    self.items.append((key, cut, stop, ids, prompt))
                    self.need[:, len(self.items) - 1] = stop - cut, self._loss(cut, stop, prompt)
                if cut == start:
                    break
                item = (key, start, cut, ids, prompt)
            placed.append(item)
            left -= item[2] - item[1], self._loss(item[1], item[2], item[4])
            segments -= 1
        self._emit(placed)

    def _emit(self, placed: list[tuple]) -> None:
        """Write a sequence; one that is not full is cut into sequences of lengths that are powers of two."""
        total = sum(x[2] - x[1] for x in placed)
        sizes = [total] if total == self.limits.tokens else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        rest = list(reversed(placed))
        for size in sizes:
            offset = 0
            while offset < size:
                key, start, stop, ids, prompt = rest.pop()
                cut = min(stop, start + size - offset)
                if cut < stop:
                    rest.append((key, cut, stop, ids, prompt))
                part = ids[4 * start : 4 * cut]
                self.out.append((key, start, cut - start, zlib.crc32(part), len(ids) // 4, self.sequence, offset, part if self.emit_ids else None))
                offset += cut - start
            self.sequence += 1

    def finish(self) -> None:
        while self.items:
            self._fill()

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1, emit_ids: bool = False, prompt_column: str | None = None) -> DataFrame:
    """One row per piece (see ``SCHEMA``; with ``emit_ids`` also ``ids``, the piece's little-endian 32-bit ids)."""
    end = np.array([end_id], "<u4").tobytes()
    schema = SCHEMA + (", ids binary" if emit_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64()] * 7 + [pa.binary()] * emit_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tokenizer = Packer(limits, TaskContext.get().partitionId() << 40, emit_ids), WordTokenizer.get(tokenizer_path)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.drain(), strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

        for batch in pieces(batches, "text", SLICE):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            prompts = batch.column("prompt").to_pylist()
            for key, ids, prompt in zip(batch.column("doc_id").to_pylist(), tokenizer.encode([t or b"" for t in texts]), prompts, strict=True):
                packer.add(key, ids + end, prompt or 0)
            yield rows()
        packer.finish()
        yield rows()

    prompt = F.col(prompt_column).cast("long") if prompt_column else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), prompt.alias("prompt")).mapInArrow(thrifty(run), schema)
