"""What all readers share: sources, options, structure helpers and rows.

Rows are DataFrames of ``record_number``, ``physical_line`` and one text column ``cN`` for each source column.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.headers import HeaderNormalizer
from ..model import EngineError, InvalidSource, Limits, SourceColumn, SourceStructure, redacted

#: Files up to this size are parsed at once; larger ones line by line, or by Spark's own reader.
WHOLE_BYTES = 64 << 20
NUMBER = re.compile(r"[-+]?\d+(?:[.,]\d+)?")
CODED = re.compile(r"SW\[([A-Z_]+)\]")
PLAIN = HeaderNormalizer()


def coded(code: str) -> ValueError:
    """An error that a Python worker can raise; it holds the code and never a value."""
    return ValueError(f"SW[{code}]")


def guarded(action):
    """Run an action; a code raised in a worker comes back as an EngineError without the worker's text."""
    try:
        return action()
    except PySparkException as e:
        found = CODED.search(str(e))
        raise InvalidSource(found[1] if found else "READ_FAILED", "the source could not be read") from None


@dataclass(frozen=True)
class Source:
    """A read-only file; ``name`` never holds a folder."""

    path: str

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]

    def _frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("binaryFile").load(self.path)

    def _single(self, spark: SparkSession):
        """(file system, path) where the source is one plain file, else None."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return (system, path) if system.exists(path) and system.getFileStatus(path).isFile() else None

    def size(self, spark: SparkSession) -> int:
        if found := self._single(spark):
            return int(found[0].getFileStatus(found[1]).getLen())
        try:
            row = self._frame(spark).agg(F.sum("length").alias("n")).first()
        except PySparkException:
            raise InvalidSource("SOURCE_NOT_FOUND", "no such source") from None
        return int(row.n or 0)

    def content(self, spark: SparkSession) -> bytes:
        rows = self._frame(spark).select("content").take(1)
        return bytes(rows[0].content) if rows else b""

    def head(self, spark: SparkSession, size: int = 1 << 20) -> bytes:
        if found := self._single(spark):
            stream = found[0].open(found[1])
            try:
                return bytes(stream.readNBytes(size))
            finally:
                stream.close()
        if self.size(spark) <= WHOLE_BYTES:
            return self.content(spark)[:size]
        rows = spark.read.text(self.path).limit(200).collect()
        return "\n".join(r.value for r in rows).encode()[:size]

    def sha256(self, spark: SparkSession) -> str:
        """Of the bytes, at any size; of several files, of their names below the common folder and their hashes.

        The driver streams each file once in a fixed buffer: the digest of one file cannot be made in parts.
        """
        self.size(spark)  # refuses a missing source
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        hashes = {}
        files = [self.path] if self._single(spark) else [r.path for r in self._frame(spark).select("path").collect()]
        for name in files:
            path = jvm.org.apache.hadoop.fs.Path(name)
            stream = path.getFileSystem(conf).open(path)
            try:
                hashes[name] = jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
            finally:
                stream.close()
        if len(hashes) == 1:
            return next(iter(hashes.values()))
        top = len(os.path.commonpath(hashes)) if hashes else 0
        return hashlib.sha256(repr(sorted([p[top:], h] for p, h in hashes.items())).encode()).hexdigest()


def from_bytes(data: bytes, name: str, limit: int = 64 << 20) -> Source:
    """A source of bytes or of a stream's content under a size limit; the name is a plain file name."""
    if hasattr(data, "read"):
        data = data.read(limit + 1)
    if len(data) > limit:
        raise InvalidSource("SOURCE_TOO_LARGE", "source exceeds the byte limit")
    if not name or name in (".", "..") or re.search(r"[/\\\x00-\x1f:]", name):
        raise InvalidSource("INVALID_SOURCE_NAME", "a plain file name is needed")
    path = os.path.join(tempfile.mkdtemp(prefix="schemaweave-"), name)
    with open(path, "wb") as out:
        out.write(bytes(data))
    os.chmod(path, 0o600)
    return Source(f"file://{path}")


@dataclass
class Rows:
    """Rows of a source and what is known of them."""

    frame: DataFrame
    structure: SourceStructure
    warnings: list[str] = field(default_factory=list)
    ordered: bool = False  # one task gives all rows in order

    @contextmanager
    def spread(self) -> Iterator[DataFrame]:
        """The rows for several passes: what one task has parsed is dealt out to all cores and kept, on disk where it is large."""
        if not self.ordered:
            yield self.frame
            return
        spark = self.frame.sparkSession
        kept = self.frame.repartition(2 * spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield kept
        finally:
            kept.unpersist()


def check_options(options: dict[str, str], known: set[str]) -> None:
    if set(options) - known:
        raise EngineError("INVALID_READER_OPTION", "unknown option")


def header_row(mode: str, first: list[str]) -> bool:
    """Whether the first record is a header: asked for, or unique, filled and free of numbers."""
    if mode not in ("first", "none", "detect"):
        raise EngineError("INVALID_READER_OPTION", "header is first, none or detect")
    if mode != "detect":
        return mode == "first"
    names = [c.strip() for c in first]
    return len(set(names)) == len(names) and all(names) and not any(NUMBER.fullmatch(n) for n in names)


def columns_of(names: list[str], limits: Limits) -> tuple[tuple[SourceColumn, ...], list[str]]:
    if len(names) > limits.max_columns:
        raise InvalidSource("COLUMN_LIMIT", "too many columns")
    if any(len(n) > limits.max_header_chars for n in names):
        raise InvalidSource("HEADER_LIMIT", "a header is too long")
    columns, warnings, seen = [], [], set()
    for k, name in enumerate(names):
        if not name.strip():
            warnings.append(f"empty header at column c{k}")
        elif name.strip() in seen:
            warnings.append(f"duplicate header: {redacted(len(name))}")
        seen.add(name.strip())
        columns.append(SourceColumn(f"c{k}", k, name, PLAIN(name).comparable))
    return tuple(columns), warnings


def row_schema(width: int) -> T.StructType:
    fields = [T.StructField("record_number", T.LongType()), T.StructField("physical_line", T.LongType())]
    return T.StructType(fields + [T.StructField(f"c{k}", T.StringType()) for k in range(width)])


def batches_of(rows: Iterator[tuple], width: int, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (record_number, physical_line, values)."""
    names = ["record_number", "physical_line"] + [f"c{k}" for k in range(width)]
    kept: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in kept], pa.int64()), pa.array([r[1] for r in kept], pa.int64())]
        columns += [pa.array([r[2][k] for r in kept], pa.string()) for k in range(width)]
        return pa.RecordBatch.from_arrays(columns, names)

    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield batch()
            kept.clear()
    yield batch()


def parsed(spark: SparkSession, source: Source, width: int, parse) -> DataFrame:
    """Rows of a file that one task parses; ``parse`` turns its bytes into (record_number, physical_line, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for content in found.column("content"):
                yield from batches_of(parse(content.as_py()), width)

    return source._frame(spark).select("content").mapInArrow(run, row_schema(width))


def streamed(spark: SparkSession, source: Source, width: int, parse) -> DataFrame:
    """As ``parsed`` for files of any size: one task gets the lines in order; ``parse`` takes an iterator of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((path, data.as_py()) for found in batches for path, data in zip(found.column("path").to_pylist(), found.column("line"), strict=True))
        for _, own in groupby(lines, key=lambda x: x[0]):
            yield from batches_of(parse(data + b"\n" for _, data in own), width)

    lines = spark.read.option("lineSep", "\n").text(source.path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    return lines.coalesce(1).sortWithinPartitions("path", "start", "at").select("path", "line").mapInArrow(run, row_schema(width))


def number_rows(frame: DataFrame, first: int = 1) -> DataFrame:
    """Adds consecutive record numbers in the order of the frame's partitions; only counts reach the driver."""
    marked = frame.withColumn("part__", F.spark_partition_id()).withColumn("at__", F.monotonically_increasing_id())
    counts = {r.part__: r["count"] for r in marked.groupBy("part__").count().collect()}
    offsets, total = {}, first
    for part in sorted(counts):
        offsets[part] = total
        total += counts[part]
    table = F.create_map(*[x for k, v in offsets.items() for x in (F.lit(k), F.lit(v))]) if offsets else F.create_map(F.lit(0), F.lit(first))
    number = F.element_at(table, F.col("part__")).cast("long") + F.col("at__").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("record_number", number).drop("part__", "at__")
