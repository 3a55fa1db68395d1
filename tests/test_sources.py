"""CSV and Excel readers and in-memory sources."""

import hashlib
import io
import struct
import zipfile

import pytest

from schemaweave.facade import Engine
from schemaweave.model import EngineError, InvalidSource, Limits
from schemaweave.sources import base, xls, xlsx
from schemaweave.sources.csv import CsvReader
from schemaweave.sources.frame import from_frame


def read(spark, data, name="a.csv", **options):
    engine = Engine(spark)
    rows, structure = engine._open(base.from_bytes(data, name), options)
    width = len(structure.columns)
    got = base.guarded(lambda: rows.frame.orderBy("record_number").collect())
    return structure, [(r.record_number, r.physical_line, [r[f"c{k}"] for k in range(width)]) for r in got]


def code_of(action):
    with pytest.raises(EngineError) as e:
        action()
    return e.value.code


def test_quotes_lines_and_bom(spark):
    structure, rows = read(spark, '﻿Name;Note\nAna;"a ""b"" c"\nBob;"two\nlines; here"\nEva;\n'.encode())
    assert [c.header for c in structure.columns] == ["Name", "Note"] and structure.delimiter == ";"
    assert rows == [(2, 2, ["Ana", 'a "b" c']), (3, 4, ["Bob", "two\nlines; here"]), (4, 5, ["Eva", ""])]


def test_headers(spark):
    structure, _ = read(spark, b"N,N,\na,b,c\n", header="first")
    assert list(structure.warnings) == ["duplicate header: <redacted:length=1>", "empty header at column c2"]
    structure, rows = read(spark, b"1,2\n3,4\n")
    assert not structure.header_present and [c.header for c in structure.columns] == ["column_1", "column_2"] and rows[0][0] == 1


def test_charsets(spark):
    for charset, name in (("ISO-8859-1", "latin-1"), ("WINDOWS-1252", "cp1252")):
        _, rows = read(spark, "Nome,Ref\nJoão,1\n".encode(name), charset=charset)
        assert rows[0][2] == ["João", "1"]
    assert code_of(lambda: read(spark, b"a,b\n", charset="UTF-7")) == "UNSUPPORTED_CHARSET"
    assert code_of(lambda: read(spark, b"A,B\n\xff,x\n")) == "CSV_READ_FAILED"


def test_refusals(spark):
    assert code_of(lambda: read(spark, b"A,B\n1,2,3\n")) == "IRREGULAR_ROW"
    assert code_of(lambda: read(spark, b"A,B\nx,y\n\nz,w\n")) == "IRREGULAR_ROW"
    assert code_of(lambda: read(spark, b"single\nvalue\n")) == "CSV_DELIMITER_AMBIGUOUS"
    assert code_of(lambda: read(spark, b" ")) == "CSV_DETECTION_FAILED"
    assert code_of(lambda: read(spark, b"A,B\n", color="red")) == "INVALID_READER_OPTION"
    assert code_of(lambda: read(spark, b"x", name="a.bin")) == "UNSUPPORTED_SOURCE"
    assert code_of(lambda: CsvReader().detect(spark, base.from_bytes(b"A,B,C\n1,2,3\n", "a.csv"), {}, Limits(max_columns=2))) == "COLUMN_LIMIT"


def test_large_files_take_the_splittable_reader(spark, monkeypatch):
    data = b"A,B\n" + b"".join(b'%d,"x ""%d"""\n' % (k, k) for k in range(500))
    small = read(spark, data)[1]
    monkeypatch.setattr("schemaweave.sources.csv.WHOLE_BYTES", 10)
    large = read(spark, data)[1]
    assert [(n, v) for n, _, v in large] == [(n, v) for n, _, v in small]
    assert code_of(lambda: read(spark, b"A,B\n1,2,3\n" * 5)) == "IRREGULAR_ROW"


def test_large_files_keep_quoted_line_breaks_and_limits(spark, monkeypatch):
    files = [b'A,B\n' + b'"two\nlines","x\r\ny"\n1,2\n' * 50, b'A\n"one\n\ntwo"\nthree\n', '\ufeffA;B\r\n"a\r\nb";"é😀"\r\n'.encode()]
    options = [{}, {"delimiter": ",", "header": "first"}, {}]
    small = [read(spark, data, **o) for data, o in zip(files, options, strict=True)]
    for size in (base.WHOLE_BYTES, 1):
        monkeypatch.setattr("schemaweave.sources.csv.WHOLE_BYTES", size)
        for (structure, rows), data, o in zip(small, files, options, strict=True):
            again, got = read(spark, data, **o)
            assert again == structure and got == rows
        source = base.from_bytes(b"A,B\nabcdef,2\nabcde,2\n", "a.csv")
        reader = CsvReader()
        for longest in (5, 6):
            limits = Limits(max_field_chars=longest)
            rows = reader.open(spark, source, reader.detect(spark, source, {}, limits), {}, limits)
            collect = lambda rows=rows: base.guarded(lambda: rows.frame.collect())
            assert len(collect()) == 2 if longest == 6 else code_of(collect) == "FIELD_LIMIT"


def test_large_files_can_be_split_by_request(spark, monkeypatch):
    data = b"A,B\n" + b"".join(b"%d,abcdef\n" % k for k in range(300))
    monkeypatch.setattr("schemaweave.sources.csv.WHOLE_BYTES", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        whole, split = read(spark, data)[1], read(spark, data, multiline="false")[1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(n, v) for n, _, v in whole] == [(n, v) for n, _, v in split] == [(k + 2, [str(k), "abcdef"]) for k in range(300)]
    assert [line for _, line, _ in whole] == list(range(2, 302))
    source, reader, limits = base.from_bytes(data, "a.csv"), CsvReader(), Limits(max_field_chars=5)
    rows = reader.open(spark, source, reader.detect(spark, source, {}, limits), {"multiline": "false"}, limits)
    assert code_of(lambda: base.guarded(lambda: rows.frame.collect())) == "FIELD_LIMIT"
    assert code_of(lambda: read(spark, b"A,B\nx,y\n\nz,w\n")) == "IRREGULAR_ROW"


def test_bytes_and_streams(spark):
    assert base.from_bytes(io.BytesIO(b"a,b\n"), "a.csv").content(spark) == b"a,b\n"
    for name in ("../a.csv", "", "a/b.csv", "a\\b"):
        assert code_of(lambda name=name: base.from_bytes(b"x", name)) == "INVALID_SOURCE_NAME"
    assert code_of(lambda: base.from_bytes(b"x" * 10, "a.csv", limit=5)) == "SOURCE_TOO_LARGE"
    one, two = base.from_bytes(b"same", "a.csv"), base.from_bytes(b"same", "b.csv")
    assert one.sha256(spark) == two.sha256(spark)


def test_fingerprints_are_of_the_content(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(base.Source, "size", lambda self, spark: 2 << 30)  # as a large source
    data = b"0123456789abcdef" * 300_000
    one, two, other = (base.from_bytes(x, n) for x, n in ((data, "a.csv"), (data, "b.csv"), (data[:-1] + b"!", "a.csv")))
    assert one.sha256(spark) == two.sha256(spark) == hashlib.sha256(data).hexdigest()
    assert other.sha256(spark) == hashlib.sha256(data[:-1] + b"!").hexdigest()
    for folder, last in (("x", b"2"), ("y", b"2"), ("z", b"3")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.csv").write_bytes(b"1")
        (tmp_path / folder / "2.csv").write_bytes(last)
    x, y, z = (base.Source(f"file://{tmp_path}/{f}").sha256(spark) for f in "xyz")
    assert x == y != z


def test_frames(spark):
    frame = spark.range(5).selectExpr("id", "CAST(id / 2 AS double) AS half", "CASE WHEN id = 3 THEN NULL ELSE 'x' END AS s")
    rows = from_frame(frame, order="id")
    got = rows.frame.orderBy("record_number").collect()
    assert [(r.record_number, r.c0, r.c1) for r in got][3] == (3, "1.50", "") and len(rows.structure.columns) == 2
    assert sorted(r.record_number for r in from_frame(frame.repartition(3)).frame.collect()) == [1, 2, 3, 4, 5]


WORKBOOK = '<workbook xmlns="x" xmlns:r="r"><sheets>{}</sheets></workbook>'
RELS = '<Relationships xmlns="p">{}</Relationships>'
STYLES = '<styleSheet xmlns="x"><numFmts><numFmt numFmtId="164" formatCode="000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="4"/></cellXfs></styleSheet>'


def workbook(sheets, extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", WORKBOOK.format("".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(sheets))))
        z.writestr("xl/_rels/workbook.xml.rels", RELS.format("".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets)))))
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>Nome</t></si><si><r><t>A</t></r><r><t>na</t></r></si></sst>')
        z.writestr("xl/styles.xml", STYLES)
        for k, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="x"><sheetData>{body}</sheetData></worksheet>')
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


SHEET = (
    '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>Vazio</t></is></c><c r="C2" t="str"><v>Cod</v></c><c r="D2" t="str"><v>Data</v></c><c r="E2" t="str"><v>F</v></c></row>'
    '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" s="2"><v>7</v></c><c r="D3" s="1"><v>45293</v></c><c r="E3"><f>1+1</f><v>2</v></c></row>'
    '<row r="4"><c r="A4" t="b"><v>1</v></c><c r="C4" s="3"><v>1234.5</v></c><c r="D4" s="1"><v>45293.5</v></c><c r="E4" t="e"><v>#N/A</v></c></row>'
)


def test_xlsx_cells(spark):
    structure, rows = read(spark, workbook({"S": SHEET}), "a.bin")
    assert structure.format == "xlsx" and [c.header for c in structure.columns] == ["Nome", "Vazio", "Cod", "Data", "F"]
    assert rows == [(1, 3, ["Ana", "", "007", "2024-01-02", "2"]), (2, 4, ["true", "", "1,234.50", "2024-01-02T12:00:00", ""])]
    assert read(spark, workbook({"S": SHEET}), "a.xlsx", formula="expression")[1][0][2][4] == "=1+1"
    assert code_of(lambda: read(spark, workbook({"S": SHEET}), "a.xlsx", formula="reject")) == "EXCEL_FORMULA_REJECTED"


def test_xlsx_sheets(spark):
    two = workbook({"first": SHEET, "0": SHEET.replace("Cod", "Named")})
    assert code_of(lambda: read(spark, two, "a.xlsx")) == "EXCEL_SHEET_AMBIGUOUS"
    assert read(spark, two, "a.xlsx", sheet="0")[0].columns[2].header == "Named"
    assert read(spark, two, "a.xlsx", sheet="1")[0].columns[2].header == "Named"
    assert code_of(lambda: read(spark, two, "a.xlsx", sheet="none")) == "EXCEL_SHEET_NOT_FOUND"
    assert code_of(lambda: read(spark, workbook({"S": '<row r="40"><c r="A40"><v>1</v></c></row>'}), "a.xlsx")) == "EXCEL_PREAMBLE_LIMIT"
    assert code_of(lambda: read(spark, workbook({"S": ""}), "a.xlsx")) == "EXCEL_EMPTY_WORKBOOK"


@pytest.mark.parametrize(
    ("extra", "code"),
    [
        ({"xl/vbaProject.bin": "x"}, "XLSX_MACRO_FORBIDDEN"), ({"../x.xml": "x"}, "XLSX_UNSAFE_ENTRY"), ({"xl/rels/a.rels": RELS.format('<R TargetMode="External"/>')}, "XLSX_EXTERNAL_REFERENCE"),
        ({"xl/a.xml": "<!DOCTYPE x>"}, "XLSX_DTD_FORBIDDEN"), ({"xl/b.bin": "0" * 10_000_000}, "XLSX_ZIP_EXPANSION_LIMIT"),
    ],
)
def test_xlsx_preflight(spark, extra, code):
    assert code_of(lambda: read(spark, workbook({"S": SHEET}, extra), "a.xlsx")) == code
    assert code_of(lambda: read(spark, b"PK broken", "a.xlsx")) == "EXCEL_INVALID_CONTAINER"


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def legacy_workbook():
    text = lambda s: struct.pack("<HB", len(s), 0) + s.encode("latin-1")
    sst = record(xls.SST, struct.pack("<II", 3, 3) + text("Nome") + text("Cod") + struct.pack("<HB", 3, 1) + "Zoë".encode("utf-16-le"))
    head = record(xls.BOF, bytes(16)) + record(xls.FORMAT, struct.pack("<HHB", 164, 3, 0) + b"000")
    head += b"".join(record(xls.XF, struct.pack("<HH", 0, f) + bytes(16)) for f in (0, 164, 14))
    sheet = record(xls.BOF, bytes(16))
    sheet += record(xls.LABEL_SST, struct.pack("<HHHI", 0, 0, 0, 0)) + record(xls.LABEL_SST, struct.pack("<HHHI", 0, 1, 0, 1))
    sheet += record(xls.LABEL_SST, struct.pack("<HHHI", 1, 0, 0, 2)) + record(xls.RK, struct.pack("<HHHI", 1, 1, 1, (7 << 2) | 2))
    sheet += record(xls.BOOL_ERR, struct.pack("<HHHBB", 2, 0, 0, 1, 0)) + record(xls.NUMBER, struct.pack("<HHHd", 2, 1, 2, 45293.0)) + record(xls.EOF, b"")
    named = lambda at: record(xls.SHEET, struct.pack("<IBB", at, 0, 0) + struct.pack("<BB", 1, 0) + b"S")
    at = len(head + named(0) + sst + record(xls.EOF, b""))
    stream = head + named(at) + sst + record(xls.EOF, b"") + sheet
    stream += bytes(4096 - len(stream))
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    fat = [0xFFFFFFFD, end, *range(3, 10), end] + [free] * 118
    entry = lambda name, kind, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + bytes(48) + struct.pack("<II", start, size)).ljust(128, b"\0")
    directory = (entry("Root Entry", 5, end, 0) + entry("Workbook", 2, 2, 4096)).ljust(512, b"\0")
    header = xls.OLE2 + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, end, 0, end, 0)
    header += struct.pack("<I", 0) + struct.pack("<I", free) * 108
    return header + struct.pack("<128I", *fat) + directory + stream


def test_legacy_workbook(spark):
    structure, rows = read(spark, legacy_workbook(), "old.dat")
    assert structure.format == "xls" and [c.header for c in structure.columns] == ["Nome", "Cod"]
    assert [r[2] for r in rows] == [["Zoë", "007"], ["true", "2024-01-02"]]
    assert code_of(lambda: read(spark, xls.OLE2 + bytes(600), "a.xls")) == "EXCEL_INVALID_CONTAINER"


def test_formats():
    assert xlsx.render_number("1234.5", "#,##0.00") == "1,234.50" and xlsx.render_number("0.256", "0%") == "26%" and xlsx.render_number("1e21", "General") == "1E+21"
    assert xlsx.render_date(1.0, True) == "1904-01-02" and xlsx.is_date_format("dd/mm/yyyy") and not xlsx.is_date_format('0.00 "days"')


def test_missing_source(spark):
    with pytest.raises(InvalidSource):
        Engine(spark)._open(base.Source("file:///nowhere/a.csv"), {})
