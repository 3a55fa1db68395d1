"""Legacy XLS workbooks: the compound file and the BIFF8 records that carry cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .base import coded
from .xlsx import BUILT_IN, OLE2, XlsxReader, is_date_format, render_date, render_number

MAX_BYTES = 20 << 20
FREE = 0xFFFFFFFA
#: BIFF8 record numbers: fixed values.
BOF, EOF, SHEET, SST, CONTINUE, FORMAT, XF, EPOCH, FILEPASS = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x41E, 0xE0, 0x22, 0x2F
LABEL_SST, NUMBER, RK, MUL_RK, BOOL_ERR, FORMULA, STRING, LABEL = 0xFD, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0x204
ERROR_WARNING, FORMULA_WARNING = "error cell was read as blank", "formula without a cached value was read as blank"


def workbook_stream(data: bytes) -> bytes:
    """The workbook's stream of a compound file."""
    if len(data) > MAX_BYTES:
        raise coded("XLS_LEGACY_SIZE_LIMIT")
    if not data.startswith(OLE2) or len(data) < 512:
        raise coded("EXCEL_INVALID_CONTAINER")
    try:
        size, mini_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, cutoff, first_mini = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60))
        sector = lambda k: data[(k + 1) * size : (k + 2) * size]
        fats = [x for x in struct.unpack_from("<109I", data, 76) if x < FREE]
        more = struct.unpack_from("<I", data, 68)[0]
        while more < FREE and len(fats) < len(data) // size:
            entries = struct.unpack(f"<{size // 4}I", sector(more))
            fats += [x for x in entries[:-1] if x < FREE]
            more = entries[-1]
        fat = [x for k in fats for x in struct.unpack(f"<{size // 4}I", sector(k))]

        def chain(first: int, table: list[int]) -> Iterator[int]:
            seen = 0
            while first < FREE and seen <= len(table):
                yield first
                first, seen = table[first], seen + 1

        directory = b"".join(map(sector, chain(first_dir, fat)))
        entries = {}
        for at in range(0, len(directory) - 127, 128):
            length = struct.unpack_from("<H", directory, at + 64)[0]
            name = directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
            entries.setdefault(name, struct.unpack_from("<II", directory, at + 116))
        start, length = entries.get("Workbook") or entries["Book"]
        if length >= cutoff:
            return b"".join(map(sector, chain(start, fat)))[:length]
        root = b"".join(map(sector, chain(entries["Root Entry"][0], fat)))
        minis = [x for k in chain(first_mini, fat) for x in struct.unpack(f"<{size // 4}I", sector(k))]
        return b"".join(root[k * mini_size : (k + 1) * mini_size] for k in chain(start, minis))[:length]
    except (struct.error, KeyError, IndexError):
        raise coded("EXCEL_INVALID_CONTAINER") from None


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, length = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + length]
        at += 4 + length


class Strings:
    """Reads strings over a chain of record parts; a string that goes on in the next part repeats its width flag."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
            some = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + some, n - len(some), self.at + len(some)
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, text = flags & 1, ""
        while count:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 1
                wide = self.parts[self.part][0] & 1
            left = (len(self.parts[self.part]) - self.at) // (2 if wide else 1)
            n = min(count, left)
            text += self.take(n * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1")
            count -= n
        self.take(4 * runs + extra)
        return text


def rk_number(raw: int) -> float:
    value = float(struct.unpack("<i", struct.pack("<I", raw))[0] >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class LegacyWorkbook:
    """Sheets, strings and formats of a BIFF8 workbook; the interface is the one of the XML workbook."""

    def __init__(self, data: bytes):
        self.stream = workbook_stream(data)
        self.sheets: list[tuple[str, str]] = []
        own, kinds, parts, epoch = dict(BUILT_IN), [], [], False
        last = 0
        for kind, body in records(self.stream):
            if kind == EOF:
                break
            if kind == FILEPASS:
                raise coded("EXCEL_ENCRYPTED")
            if kind == SHEET and body[5] == 0:
                size, flags = body[6], body[7]
                name = body[8 : 8 + size * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1")
                self.sheets.append((name, str(struct.unpack_from("<I", body)[0])))
            elif kind == SST or kind == CONTINUE and last == SST:
                parts.append(body)
                kind = SST
            elif kind == FORMAT:
                ident, size, flags = struct.unpack_from("<HHB", body)
                own[ident] = body[5 : 5 + size * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1")
            elif kind == XF:
                kinds.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == EPOCH:
                epoch = body[0] == 1
            last = kind
        self.epoch_1904, self.formats = epoch, [own.get(k, "General") for k in kinds]
        self.strings = self._strings(parts)

    @staticmethod
    def _strings(parts: list[bytes]) -> list[str]:
        if not parts:
            return []
        reader = Strings(parts)
        try:
            _, unique = struct.unpack("<II", reader.take(8))
            return [reader.string() for _ in range(unique)]
        except (IndexError, struct.error):
            raise coded("EXCEL_STRUCTURE_INVALID") from None

    def choose(self, wanted: str | None) -> str:
        if not self.sheets:
            raise coded("EXCEL_EMPTY_WORKBOOK")
        if wanted is None:
            if len(self.sheets) > 1:
                raise coded("EXCEL_SHEET_AMBIGUOUS")
            return self.sheets[0][1]
        named = dict(self.sheets)
        if wanted in named:
            return named[wanted]
        if wanted.isdigit() and int(wanted) < len(self.sheets):
            return self.sheets[int(wanted)][1]
        raise coded("EXCEL_SHEET_NOT_FOUND")

    def _number(self, value: float, style: int) -> str:
        code = self.formats[style] if style < len(self.formats) else "General"
        return render_date(value, self.epoch_1904) if is_date_format(code) else render_number(repr(value), code)

    def rows(self, part: str, formula: str, warnings: set[str]) -> Iterator[tuple[int, list[str]]]:
        cells: dict[int, dict[int, str]] = {}
        pending = None
        for kind, body in records(self.stream, int(part)):
            if kind == EOF:
                break
            if kind in (LABEL_SST, NUMBER, RK, BOOL_ERR, FORMULA, LABEL):
                row, col, style = struct.unpack_from("<HHH", body)
                put = cells.setdefault(row, {}).__setitem__
            if kind == LABEL_SST:
                put(col, self.strings[struct.unpack_from("<I", body, 6)[0]])
            elif kind == LABEL:
                put(col, Strings([body[6:]]).string())
            elif kind == NUMBER:
                put(col, self._number(struct.unpack_from("<d", body, 6)[0], style))
            elif kind == RK:
                put(col, self._number(rk_number(struct.unpack_from("<I", body, 6)[0]), style))
            elif kind == MUL_RK:
                row, col = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    style, raw = struct.unpack_from("<HI", body, 4 + 6 * k)
                    cells.setdefault(row, {})[col + k] = self._number(rk_number(raw), style)
            elif kind == BOOL_ERR:
                if body[7]:
                    warnings.add(ERROR_WARNING)
                put(col, "" if body[7] else "true" if body[6] else "false")
            elif kind == FORMULA:
                if formula == "reject":
                    raise coded("EXCEL_FORMULA_REJECTED")
                if formula == "expression":
                    raise coded("XLS_FORMULA_EXPRESSION_UNSUPPORTED")
                result = body[6:14]
                if result[6:8] != b"\xff\xff":
                    put(col, self._number(struct.unpack("<d", result)[0], style))
                elif result[0] == 0:
                    pending = (row, col)
                elif result[0] == 1:
                    put(col, "true" if result[2] else "false")
                else:
                    warnings.add(ERROR_WARNING if result[0] == 2 else FORMULA_WARNING)
                    put(col, "")
            elif kind == STRING and pending:
                cells[pending[0]][pending[1]] = Strings([body]).string()
                pending = None
        for row in sorted(cells):
            out = [cells[row].get(k, "") for k in range(max(cells[row]) + 1)]
            while out and not out[-1].strip():
                out.pop()
            yield row + 1, out


class XlsReader(XlsxReader):
    """Reads compound files with a workbook."""

    format = "xls"
    workbook = staticmethod(LegacyWorkbook)
