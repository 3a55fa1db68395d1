"""XLSX workbooks: a preflight of the container, then rows from the sheet's XML, read by one task.

Formulas are never evaluated. Number formats are rendered for the general format, fixed decimals, zero padding,
percentages and dates; any other format falls back to the general one.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

from pyspark.sql import SparkSession

from ..model import EngineError, InvalidSource, Limits, SourceStructure
from .base import Rows, Source, check_options, coded, columns_of, header_row, parsed

OPTIONS = {"sheet", "formula", "header", "maxPreambleRows"}
FORMULAS = ("cached", "expression", "reject")
MAX_ENTRIES, MAX_EXPANDED, MAX_ENTRY, MIN_RATIO = 10_000, 512 << 20, 128 << 20, 0.01
PREVIEW_ROWS, PREVIEW_PHYSICAL = 20, 1_000
#: Built-in number formats by id: fixed values.
BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}
OLE2, ZIP = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK"


def container(head: bytes) -> str:
    """What the first bytes tell, whatever the name says: xls, xlsx or nothing."""
    return "xls" if head.startswith(OLE2) else "xlsx" if head.startswith(ZIP) else ""


def preflight(data: bytes) -> zipfile.ZipFile:
    """Refuses containers that are damaged, too large, suspicious or active."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise coded("EXCEL_INVALID_CONTAINER") from None
    entries = z.infolist()
    if len(entries) > MAX_ENTRIES:
        raise coded("XLSX_ZIP_ENTRY_LIMIT")
    names = {e.filename for e in entries}
    for e in entries:
        if e.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", e.filename) or ":" in e.filename:
            raise coded("XLSX_UNSAFE_ENTRY")
        if e.flag_bits & 1 or (e.external_attr >> 16) & 0o170000 == 0o120000 or e.compress_type not in (0, 8):
            raise coded("XLSX_UNSUPPORTED_ZIP_ENTRY")
        if e.file_size > MAX_ENTRY or e.file_size and e.compress_size / e.file_size < MIN_RATIO:
            raise coded("XLSX_ZIP_EXPANSION_LIMIT")
        if e.filename.lower().endswith("vbaproject.bin"):
            raise coded("XLSX_MACRO_FORBIDDEN")
    if sum(e.file_size for e in entries) > MAX_EXPANDED:
        raise coded("XLSX_ZIP_EXPANSION_LIMIT")
    if not {"[Content_Types].xml", "xl/workbook.xml"} <= names:
        raise coded("EXCEL_INVALID_CONTAINER")
    for name in names:
        if name.endswith((".xml", ".rels")):
            head = z.open(name).read(4096)
            if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
                raise coded("XLSX_DTD_FORBIDDEN")
        if name.endswith(".rels") and b'TargetMode="External"' in z.read(name):
            raise coded("XLSX_EXTERNAL_REFERENCE")
    return z


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(z.read(name))
    except KeyError:
        return None
    except ElementTree.ParseError:
        raise coded("EXCEL_STRUCTURE_INVALID") from None


def is_date_format(code: str) -> bool:
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code).lower()
    return bool(re.search(r"[dyhs]|m(?!a)", plain)) and "general" not in plain and "0" not in plain.replace(".0", "")


def render_date(serial: float, epoch_1904: bool) -> str:
    base = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30)
    days = serial if epoch_1904 or serial >= 60 else serial + 1
    at = base + timedelta(days=int(days), seconds=round((days - int(days)) * 86400))
    return at.date().isoformat() if at.time() == datetime.min.time() else at.isoformat()


def render_number(text: str, code: str) -> str:
    number = Decimal(text)
    plain = re.sub(r'"[^"]*"|\\|\[[^\]]*\]', "", code.split(";")[0])
    found = re.fullmatch(r"(#,##)?(0+)(?:\.(0+))?(%?)", plain)
    if found:
        number = number * 100 if found[4] else number
        places = len(found[3] or "")
        value = number.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
        body = f"{abs(value):,.{places}f}" if found[1] else f"{abs(value):.{places}f}"
        if not found[1]:
            whole, dot, rest = body.partition(".")
            body = whole.zfill(len(found[2])) + dot + rest
        return ("-" if value < 0 else "") + body + found[4]
    short = number.normalize()
    return format(short, "f") if abs(short.adjusted()) < 11 else f"{short:E}"


class Workbook:
    """Sheets, shared strings and formats of a workbook."""

    def __init__(self, data: bytes):
        self.zip = preflight(data)
        book, rels = _xml(self.zip, "xl/workbook.xml"), _xml(self.zip, "xl/_rels/workbook.xml.rels")
        targets = {r.get("Id"): r.get("Target") for r in rels} if rels is not None else {}
        self.epoch_1904 = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        self.sheets: list[tuple[str, str]] = []
        for e in book.iter():
            if _local(e.tag) == "sheet":
                rid = next((v for k, v in e.attrib.items() if _local(k) == "id"), "")
                target = targets.get(rid, f"worksheets/sheet{len(self.sheets) + 1}.xml")
                self.sheets.append((e.get("name", ""), target.lstrip("/") if target.startswith("/xl") else f"xl/{target}"))
        strings = _xml(self.zip, "xl/sharedStrings.xml")
        self.strings = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in strings] if strings is not None else []
        self.formats = self._formats()

    def _formats(self) -> list[str]:
        styles = _xml(self.zip, "xl/styles.xml")
        if styles is None:
            return []
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _local(e.tag) == "numFmt"}
        cells = next((e for e in styles.iter() if _local(e.tag) == "cellXfs"), [])
        return [own.get(i, BUILT_IN.get(i, "General")) for i in (int(x.get("numFmtId", "0")) for x in cells)]

    def choose(self, wanted: str | None) -> str:
        """The part of the sheet: by exact name, then by index, else the only one."""
        if not self.sheets:
            raise coded("EXCEL_EMPTY_WORKBOOK")
        if wanted is None:
            if len(self.sheets) > 1:
                raise coded("EXCEL_SHEET_AMBIGUOUS")
            return self.sheets[0][1]
        for name, part in self.sheets:
            if name == wanted:
                return part
        if wanted.isdigit() and int(wanted) < len(self.sheets):
            return self.sheets[int(wanted)][1]
        raise coded("EXCEL_SHEET_NOT_FOUND")

    def cell(self, c: ElementTree.Element, formula: str, warnings: set[str]) -> str:
        kind = c.get("t", "n")
        parts = {_local(e.tag): e for e in c}
        if "f" in parts:
            if formula == "reject":
                raise coded("EXCEL_FORMULA_REJECTED")
            if formula == "expression":
                return "=" + (parts["f"].text or "")
            if "v" not in parts:
                warnings.add("formula without a cached value was read as blank")
                return ""
        text = parts["v"].text or "" if "v" in parts else ""
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
        if kind == "s":
            return self.strings[int(text)] if text else ""
        if kind == "b":
            return "true" if text == "1" else "false"
        if kind == "e":
            warnings.add("error cell was read as blank")
            return ""
        if kind in ("str", "d") or not text:
            return text
        style = int(c.get("s", "0"))
        code = self.formats[style] if style < len(self.formats) else "General"
        return render_date(float(text), self.epoch_1904) if is_date_format(code) else render_number(text, code)

    def rows(self, part: str, formula: str, warnings: set[str]) -> Iterator[tuple[int, list[str]]]:
        """(physical row, cells) of the rows that the sheet holds; gaps are empty, trailing blanks cut."""
        try:
            stream = self.zip.open(part)
        except KeyError:
            raise coded("EXCEL_SHEET_NOT_FOUND") from None
        line = 0
        for _, e in ElementTree.iterparse(stream):
            if _local(e.tag) != "row":
                continue
            line = int(e.get("r", line + 1))
            cells: list[str] = []
            for c in e:
                if _local(c.tag) != "c":
                    continue
                at = len(cells)
                if ref := re.match(r"[A-Z]+", c.get("r", "")):
                    at = 0
                    for letter in ref[0]:
                        at = at * 26 + ord(letter) - 64
                    at -= 1
                cells += [""] * (at - len(cells))
                cells.append(self.cell(c, formula, warnings))
            while cells and not cells[-1].strip():
                cells.pop()
            yield line, cells
            e.clear()


def table(rows: Iterator[tuple[int, list[str]]], preamble: int) -> Iterator[tuple[int, list[str]]]:
    """Rows that are not blank; the first must stand within the preamble."""
    first = True
    for line, cells in rows:
        if cells:
            if first and line > preamble + 1:
                raise coded("EXCEL_PREAMBLE_LIMIT")
            first = False
            yield line, cells


class XlsxReader:
    """Reads ZIP containers with a workbook."""

    format = "xlsx"
    workbook = staticmethod(Workbook)

    def supports(self, spark: SparkSession, source: Source) -> bool:
        return container(source.head(spark, 8)) == self.format

    def _rows(self, data: bytes, options: dict[str, str], warnings: set[str]) -> Iterator[tuple[int, list[str]]]:
        book = self.workbook(data)
        preamble = int(options.get("maxPreambleRows", "20"))
        return table(book.rows(book.choose(options.get("sheet")), options.get("formula", "cached"), warnings), preamble)

    def detect(self, spark: SparkSession, source: Source, options: dict[str, str], limits: Limits) -> SourceStructure:
        check_options(options, OPTIONS)
        if options.get("formula", "cached") not in FORMULAS or not options.get("maxPreambleRows", "20").isdigit():
            raise EngineError("INVALID_READER_OPTION", "unknown formula policy or preamble")
        preview, warnings = [], set()
        try:
            for line, cells in self._rows(source.content(spark), options, warnings):
                if line > PREVIEW_PHYSICAL and not preview:
                    raise coded("EXCEL_PREVIEW_LIMIT")
                preview.append(cells)
                if len(preview) >= PREVIEW_ROWS:
                    break
        except ValueError as e:
            found = re.search(r"SW\[([A-Z_]+)\]", str(e))
            raise InvalidSource(found[1] if found else "EXCEL_STRUCTURE_INVALID", "the workbook was refused") from None
        if not preview:
            raise InvalidSource("EXCEL_EMPTY_WORKBOOK", "no row found")
        width = max(map(len, preview))
        header = header_row(options.get("header", "detect"), preview[0] + [""] * (width - len(preview[0])))
        names = preview[0] if header else [f"column_{k + 1}" for k in range(width)]
        columns, notes = columns_of(names, limits)
        return SourceStructure(self.format, columns, header, attributes={"sheet": options.get("sheet", ""), "formula": options.get("formula", "cached")}, warnings=tuple(notes + sorted(warnings)))

    def open(self, spark: SparkSession, source: Source, structure: SourceStructure, options: dict[str, str], limits: Limits) -> Rows:
        width, header, longest, reader = len(structure.columns), structure.header_present, limits.max_field_chars, self

        def parse(data: bytes):
            n = 0
            for k, (line, cells) in enumerate(reader._rows(data, options, set())):
                if k == 0 and header:
                    continue
                if len(cells) > width:
                    raise coded("IRREGULAR_ROW")
                if any(len(c) > longest for c in cells):
                    raise coded("FIELD_LIMIT")
                n += 1
                yield n, line, cells + [""] * (width - len(cells))

        return Rows(parsed(spark, source, width, parse), structure, ordered=True)
