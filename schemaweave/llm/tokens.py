"""Vectorised work on the bytes of an Arrow string column.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Words and windows of words are identified by 64-bit
hashes: prefix sums of randomly coded bytes times powers of an odd base, modulo 2**64, finished by a bit mixer. Two
different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        for k, base in enumerate((BASE, inverse)):
            full = np.full(size, np.uint64(base))
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of text; a longer text stays whole in a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start, n = np.cumsum(lengths), 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of a slice of texts: byte positions ``start``/``end`` and the first word of each text in ``first``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.at = buffers(column)
        n = len(self.data)
        if lower:
            self.data = LOWER[self.data]
        solid = ~WHITE[self.data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edges = self.at[:-1][self.at[:-1] < n]
        begins[edges] = solid[edges]
        edges = self.at[1:][self.at[1:] > 0] - 1
        ends[edges] = solid[edges]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)

    @property
    def texts(self) -> int:
        return len(self.at) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.count)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        powers, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[self.data] * powers[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``width`` words inside a text, and the positions of their first words."""
        total = len(hashes)
        if total < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(total - width + 1, np.uint64)
        for k in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : total - width + 1 + k]
        last = np.repeat(self.first[1:], self.count)[: len(out)]
        inside = np.flatnonzero(np.arange(len(out)) + width <= last)
        return mix(out[inside]), inside


def sums_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive positions in ``first`` (empty stretches give 0)."""
    if values.dtype.kind == "f":  # differences of running sums would lose digits
        out = np.zeros(len(first) - 1)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            out[some] = np.add.reduceat(values, first[some])
        return out
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Marks the hashes that occur more than once within their text."""
    out = np.zeros(len(hashes), bool)
    if len(hashes):
        key = mix(hashes + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out
