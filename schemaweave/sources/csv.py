"""Delimited text: detection on a bounded preview, then a scan.

Files are parsed with full fidelity (record numbers that count the header, physical lines, blank lines as records): up to
``WHOLE_BYTES`` at once, larger ones line by line in one task, since a line break may stand inside quotes. The option
``multiline=false``, for files without quoted line breaks, sends large files through Spark's splittable reader:
physical lines are unknown there and blank lines are skipped.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell
from ..model import EngineError, InvalidSource, Limits, SourceStructure
from .base import WHOLE_BYTES, Rows, Source, check_options, coded, columns_of, header_row, number_rows, parsed, row_schema, streamed

CHARSETS = {"UTF-8": "utf-8-sig", "ISO-8859-1": "latin-1", "WINDOWS-1252": "cp1252"}
DELIMITERS = (",", ";", "\t", "|")
OPTIONS = {"charset", "delimiter", "header", "multiline"}
SAMPLE = 12


def _records(texts: Iterable[str], delimiter: str):
    """(end line, values) of all records; an empty line is a record of one empty field."""
    lines = (line for text in texts for line in io.StringIO(text, newline=""))
    reader = csv.reader(lines, delimiter=delimiter, quotechar='"', doublequote=True, strict=True)
    for values in reader:
        yield reader.line_num, values or [""]


def _decode(chunks: Iterable[bytes], charset: str) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder(CHARSETS[charset])()
    try:
        for data in chunks:
            yield decoder.decode(data)
        yield decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        raise coded("CSV_READ_FAILED") from None


class CsvReader:
    """Reads sources whose name ends in .csv."""

    format = "csv"

    def supports(self, spark: SparkSession, source: Source) -> bool:
        return source.name.lower().endswith(".csv")

    @staticmethod
    def _preview(head: bytes, charset: str, delimiter: str, n: int) -> list[list[str]]:
        text, out = head.decode(CHARSETS[charset], "replace"), []
        try:
            for _, values in _records([text], delimiter):
                out.append(values)
                if len(out) >= n:
                    break
        except csv.Error:
            pass
        return out

    def _delimiter(self, head: bytes, charset: str) -> str:
        """The one whose most common width (over 1) holds for most records, then the wider."""
        best = None
        for d in DELIMITERS:
            widths = Counter(len(r) for r in self._preview(head, charset, d, SAMPLE))
            if widths:
                width, n = max(widths.items(), key=lambda x: (x[1], x[0]))
                rank = (n / sum(widths.values()), width)
                if width > 1 and (best is None or rank > best[0]):
                    best = (rank, d)
        if best is None:
            raise InvalidSource("CSV_DELIMITER_AMBIGUOUS", "name the delimiter")
        return best[1]

    def detect(self, spark: SparkSession, source: Source, options: dict[str, str], limits: Limits) -> SourceStructure:
        check_options(options, OPTIONS)
        charset = options.get("charset", "UTF-8").upper()
        if charset not in CHARSETS:
            raise EngineError("UNSUPPORTED_CHARSET", "UTF-8, ISO-8859-1 or WINDOWS-1252")
        head = source.head(spark)
        if not head.strip():
            raise InvalidSource("CSV_DETECTION_FAILED", "the source is empty")
        delimiter = options.get("delimiter") or self._delimiter(head, charset)
        if len(delimiter) != 1:
            raise EngineError("INVALID_READER_OPTION", "a delimiter is one character")
        preview = self._preview(head, charset, delimiter, 20)
        if not preview:
            raise InvalidSource("CSV_DETECTION_FAILED", "no record found")
        header = header_row(options.get("header", "detect"), preview[0])
        names = preview[0] if header else [f"column_{k + 1}" for k in range(len(preview[0]))]
        columns, warnings = columns_of(names, limits)
        return SourceStructure("csv", columns, header, charset, delimiter, tuple(warnings))

    def open(self, spark: SparkSession, source: Source, structure: SourceStructure, options: dict[str, str], limits: Limits) -> Rows:
        width, charset, delimiter, header = len(structure.columns), structure.charset, structure.delimiter, structure.header_present
        longest = limits.max_field_chars
        large = source.size(spark) > WHOLE_BYTES
        if not large or options.get("multiline", "true").lower() != "false":

            def parse(chunks: Iterable[bytes]):
                csv.field_size_limit(longest * 4)
                try:
                    for k, (line, values) in enumerate(_records(_decode(chunks, charset), delimiter)):
                        if k == 0 and header:
                            continue
                        if len(values) != width:
                            raise coded("IRREGULAR_ROW")
                        if any(len(v) > longest for v in values):
                            raise coded("FIELD_LIMIT")
                        yield k + 1, line, values
                except csv.Error:
                    raise coded("CSV_READ_FAILED") from None

            frame = streamed(spark, source, width, parse) if large else parsed(spark, source, width, lambda data: parse([data]))
            return Rows(frame, structure, ordered=True)
        if charset == "WINDOWS-1252":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        schema = row_schema(width)[2:]
        schema = type(row_schema(0))([*schema]).add("bad__", "string")
        frame = (
            spark.read.schema(schema)
            .option("sep", delimiter).option("quote", '"').option("escape", '"').option("encoding", charset)
            .option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad__")
            .option("multiLine", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(source.path)
        )
        too_long = F.greatest(F.lit(0), F.lit(0), *[F.length(f"c{k}") for k in range(width)]) > longest
        wrong = F.when(F.col("bad__").isNotNull(), "SW[IRREGULAR_ROW]").when(too_long, "SW[FIELD_LIMIT]")
        checked = frame.withColumn("bad__", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")))
        numbered = number_rows(checked, 2 if header else 1)
        cells = [cell(F.col(f"c{k}")).alias(f"c{k}") for k in range(width)]
        kept = numbered.where("bad__ IS NULL").select("record_number", F.lit(None).cast("long").alias("physical_line"), *cells)
        return Rows(kept, structure)
