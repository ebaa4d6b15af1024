"""Excel sheets against the same rows as CSV; the workbooks are written here, cell by cell."""

from __future__ import annotations

import datetime
import zipfile
from xml.sax.saxutils import escape

import pytest

from classcraft.sources import io, xlsx

SPREADSHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def letters(i):
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def workbook(path, sheets, dates=frozenset(), late=False):
    """Text as shared strings in the first sheet and inline in others; None is a missing cell."""
    shared: list[str] = []

    def cell(s, r, c, v):
        at = f'r="{letters(c)}{r + 1}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c {at}{" s=\"1\"" if c in dates and r else ""}><v>{v!r}</v></c>'
        if v.startswith("#"):
            return f'<c {at} t="e"><v>{v}</v></c>'
        if s:
            return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        shared.append(v)
        return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SPREADSHEET}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   f'<workbookPr date1904="{int(late)}"/><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
                   + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
                   + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(i, r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{SPREADSHEET}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SPREADSHEET}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{SPREADSHEET}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
                   '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')


def test_sheet_equals_its_csv(spark, records, tmp_path):
    source = records.select("record_id", "score", "balance", "projects", "department", "outcome").orderBy("record_id")
    rows = [tuple(r) for r in source.collect()]
    workbook(tmp_path / "r.xlsx", {"data": [source.columns, *rows]})
    got = xlsx.read_sheet(spark, str(tmp_path / "r.xlsx"))
    io.write_table(source, str(tmp_path / "csv"))
    want = io.read_table(spark, str(tmp_path / "csv"))
    assert got.columns == want.columns and [t for _, t in got.dtypes] == ["bigint", "double", "double", "bigint", "string", "string"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.where("balance IS NULL").count() == source.where("balance IS NULL").count() > 0


def test_sheets_of_several_files_are_dealt_out(spark, tmp_path):
    for f in range(3):
        workbook(tmp_path / f"w{f}.xlsx", {"one": [["a"], [f]], "two & more": [["b", "c"], *[[f"t{f}", i] for i in range(4)]]})
    path = str(tmp_path / "*.xlsx")
    assert xlsx.list_sheets(spark, path).count() == 6
    assert sorted(r.a for r in xlsx.read_sheet(spark, path, "one").collect()) == [0, 1, 2]
    assert xlsx.read_sheet(spark, path, "two & more").groupBy("b").count().count() == 3
    cells = xlsx.read_cells(spark, path)
    assert cells.select("path", "sheet").distinct().count() == 6 and cells.count() == 3 * (2 + 5)


def test_values_of_all_kinds(spark, tmp_path):
    rows = [["id", "when", "flag", "text", None, "text", "note"], [1, 45000, True, "x <&> é", 1.5, "a", "#DIV/0!"], [None] * 7, [2, 45000.5, None, None, None, "b"],
            [3, None, False, "7", 2, "c", ""]]
    workbook(tmp_path / "k.xlsx", {"s": rows}, dates={1})
    got = xlsx.read_sheet(spark, str(tmp_path / "k.xlsx"))
    assert got.columns == ["id", "when", "flag", "text", "column_5", "text_6", "note"]
    assert [t for _, t in got.dtypes] == ["bigint", "timestamp", "boolean", "string", "double", "string", "string"]
    day = datetime.datetime(2023, 3, 15)
    assert sorted(map(tuple, got.collect())) == [(1, day, True, "x <&> é", 1.5, "a", None), (2, day + datetime.timedelta(hours=12), None, None, None, "b", None),
                                                 (3, None, False, "7", 2.0, "c", None)]
    workbook(tmp_path / "late.xlsx", {"s": [["when"], [43538]]}, dates={0}, late=True)
    assert xlsx.read_sheet(spark, str(tmp_path / "late.xlsx")).first()[0] == day


def test_wide_and_empty_sheets(spark, tmp_path):
    workbook(tmp_path / "w.xlsx", {"wide": [[f"c{i}" for i in range(60)], [i for i in range(60)]], "none": [], "head": [["a", "b"]]})
    path = str(tmp_path / "w.xlsx")
    assert tuple(xlsx.read_sheet(spark, path).first()) == tuple(range(60))
    assert xlsx.read_sheet(spark, path, "head").count() == 0
    with pytest.raises(ValueError, match="no rows"):
        xlsx.read_sheet(spark, path, "none")
    with pytest.raises(ValueError, match="no rows"):
        xlsx.read_sheet(spark, path, "absent")


def test_different_headers_are_refused(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"s": [["a"], [1]]})
    workbook(tmp_path / "b.xlsx", {"s": [["b"], [1]]})
    with pytest.raises(ValueError, match="different columns"):
        xlsx.read_sheet(spark, str(tmp_path / "*.xlsx"), "s")
