"""Chat formatting by columnar byte assembly.

A turn becomes ``### <role>:\\n<text> </turn>\\n``. Inside roles and texts a backslash goes before every backslash and
before every place where a control string starts (``###``, ``</turn>``; in roles also ``:``), so the first control string that is
not escaped is a real one and the format can be read back exactly. For a batch of turns the lengths of all segments
are computed, their cumulative offsets give the scatter indices, and headers, contents and ends are copied into one
preallocated buffer which becomes an Arrow column without another copy.

The turns are dealt by ranges of (conv_id, turn), so a conversation that holds a third of all rows is formatted by
many tasks; its parts carry the position of their first turn. ``read_back`` reads the parts of a conversation in
order as a stream. Hashing one conversation's text is sequential by nature, but needs constant memory.

Defined results: a null role or text is empty; turns with equal numbers are ordered by role and text; a null turn
sorts first; rows with a null conv_id form one conversation; repeated rows are repeated turns; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import buffers, pieces

HEAD, MIDDLE, END = b"### ", b":\n", b" </turn>\n"
MARKS = (b"###", b"</turn>")
TURN = re.compile(rb"### ((?:[^\\:]++|\\.)*+):\n((?:[^\\ <]++|\\.| (?!</turn>\n)|<(?!/turn>))*+) </turn>\n", re.DOTALL)
PLAIN = re.compile(rb"\\(.)", re.DOTALL)
PARTS = "conv_id long, part long, n_turns long, formatted binary, mask_start array<long>, mask_end array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _escapes(data: np.ndarray, at: np.ndarray, more: bytes = b"") -> np.ndarray:
    """Marks the bytes that get a backslash before them; a mark never spans two values."""
    out = data == 92
    for c in more:
        out |= data == c
    owner_end = np.repeat(at[1:], np.diff(at))
    for mark in MARKS:
        m = len(mark)
        if len(data) >= m:
            hit = np.ones(len(data) - m + 1, bool)
            for k, c in enumerate(mark):
                hit &= data[k : len(data) - m + 1 + k] == c
            found = np.flatnonzero(hit)
            out[found[found + m <= owner_end[found]]] = True
    return out


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns; the offsets of the turns; start and end of each text in the buffer."""
    segments = []
    for column, more in ((roles, b":"), (texts, b"")):
        data, at = buffers(column)
        marked = _escapes(data, at, more)
        upto = np.concatenate([[0], np.cumsum(marked)])
        segments.append((data, at, marked, upto, np.diff(at) + upto[at[1:]] - upto[at[:-1]]))
    n = len(texts)
    role_len, text_len = segments[0][4], segments[1][4]
    turns = np.concatenate([[0], np.cumsum(role_len + text_len + len(HEAD) + len(MIDDLE) + len(END))])
    role_at = turns[:-1] + len(HEAD)
    text_at = role_at + role_len + len(MIDDLE)
    out = np.empty(turns[-1], np.uint8)
    for literal, where in ((HEAD, turns[:-1]), (MIDDLE, role_at + role_len), (END, text_at + text_len)):
        out[where[:, None] + np.arange(len(literal))] = np.frombuffer(literal, np.uint8)
    for (data, at, marked, upto, _), where in zip(segments, (role_at, text_at), strict=True):
        owner = np.repeat(np.arange(n), np.diff(at))
        place = np.arange(len(data)) - at[owner] + upto[1:] - upto[at[owner]] + where[owner]
        out[place] = data
        out[place[marked] - 1] = 92
    return out, turns, text_at, text_at + text_len


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations: consecutive turns of a slice that belong together."""
    part = 0
    names = [x.split()[0] for x in PARTS.split(", ")]
    for batch in pieces(batches, "text"):
        conv = batch.column("conv_id")
        out, turns, start, end = assemble(batch.column("role"), batch.column("text"))
        ids = conv.to_pylist()
        firsts = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
        edges = np.array([*firsts, len(ids)])
        answer = pc.equal(batch.column("role"), "assistant").fill_null(False).to_numpy(zero_copy_only=False)
        picked = np.concatenate([[0], np.cumsum(answer)])[edges]
        base = np.repeat(turns[edges[:-1]], np.diff(edges))
        bounds = turns[edges]
        masks = [pa.ListArray.from_arrays(pa.array(picked, pa.int32()), pa.array((x - base)[answer])) for x in (start, end)]
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
        numbers = pa.array(np.arange(part, part + len(firsts)))
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(firsts)), numbers, pa.array(np.diff(edges)), body, *masks], names)
        part += len(firsts)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted parts (see ``PARTS``): ``part`` orders those of a conversation; masks are byte ranges of assistant texts."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    numbered = dealt.mapInArrow(_format, PARTS)
    return numbered.withColumn("part", F.spark_partition_id().cast("long") * F.lit(1 << 33) + F.col("part"))


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of every turn of a formatted part; raises where the bytes are not wholly made of turns."""
    out, at = [], 0
    for found in TURN.finditer(formatted):
        if found.start() != at:
            break
        out.append((PLAIN.sub(rb"\1", found[1]), PLAIN.sub(rb"\1", found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in DIGESTS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current, state, done = None, None, []

    def close() -> None:
        if state is not None:
            done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != current:
                close()
                current, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            formatted = row["formatted"]
            for role, text in read_turns(formatted):
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
            for start, end in zip(row["mask_start"], row["mask_end"], strict=True):
                text = PLAIN.sub(rb"\1", formatted[start:end])
                state[2] += len(text.decode())
                state[3].update(text)
            state[4] += len(formatted.decode())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [()] * 6, types, strict=True)], names)
        done.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [()] * 6, types, strict=True)], names)


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation (see ``DIGESTS``), parsed from the formatted bytes and the masks alone."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_read_back, DIGESTS)
