"""Excel sheets as a DataFrame.

The files are read by Spark (``binaryFile``), so any store that it reaches will do. A first pass lists the sheets of every file; a second one deals
them out by (file, sheet), so sheets are read side by side. The cells of a sheet are taken from its XML as a stream, row by row, and go on as
Arrow batches of text. A sheet has at most 1,048,576 rows, which bounds a task. The first row holds the names;
types are found from the values, as for a delimited file: whole numbers, numbers, dates and times (cells formatted as such), booleans, text.

A blank cell, a missing one and one of an error are null; wholly blank rows are left out; a sheet without rows has no columns to offer.
Shared and inline strings, formula results and booleans are read; dates count from 1900 (or 1904, if the workbook says so).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed names and numbers of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
ROWS_A_BATCH = 5_000


def _elements(archive: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements ``tag`` of a member one by one; each is emptied after use."""
    if member not in archive.namelist():
        return
    with archive.open(member) as stream:
        for _, element in ElementTree.iterparse(stream):
            if element.tag == MAIN + tag:
                yield element
                element.clear()


def sheets(content: bytes) -> list[tuple[str, str]]:
    """(name, member of the archive) of each sheet, in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        targets = {}
        with archive.open("xl/_rels/workbook.xml.rels") as stream:
            for element in ElementTree.parse(stream).getroot():
                target = element.get("Target", "")
                targets[element.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        return [(e.get("name"), targets[e.get(RELATION)]) for e in _elements(archive, "xl/workbook.xml", "sheet")]


def _column(reference: str) -> int:
    """B7 -> 1."""
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = 26 * number + ord(letter) - 64
    return number - 1


def _text(element: ElementTree.Element) -> str:
    """All runs of a string, without phonetic ones."""
    own = [t.text or "" for t in element.findall(MAIN + "t")]
    return "".join(own + [t.text or "" for r in element.findall(MAIN + "r") for t in r.findall(MAIN + "t")])


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a date or a time."""
    custom, found = set(), set()
    for e in _elements(archive, "xl/styles.xml", "numFmt"):
        plain = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", e.get("formatCode", "").lower())
        if re.search("[ymdhs]", plain):
            custom.add(int(e.get("numFmtId")))
    for e in _elements(archive, "xl/styles.xml", "cellXfs"):
        found = {i for i, xf in enumerate(e) if int(xf.get("numFmtId", 0)) in custom | DATE_FORMATS}
    return found


def rows(content: bytes, member: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as text; trailing blanks are cut."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = [_text(e) for e in _elements(archive, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(archive)
        late = any(e.get("date1904") in ("1", "true") for e in _elements(archive, "xl/workbook.xml", "workbookPr"))
        start = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        for row in _elements(archive, member, "row"):
            out: list[str | None] = []
            for cell in row.findall(MAIN + "c"):
                at = _column(cell.get("r")) if cell.get("r") else len(out)
                out += [None] * (at - len(out))
                out.append(_value(cell, shared, dates, start))
            while out and out[-1] is None:
                out.pop()
            yield out


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int], start: datetime) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(MAIN + "v")
    if kind == "inlineStr":
        inner = cell.find(MAIN + "is")
        return (_text(inner) or None) if inner is not None else None
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)] or None
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return (start + timedelta(seconds=round(float(value.text) * 86_400))).isoformat(sep=" ")
    return value.text


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, sheet, member) of every workbook under ``path``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sheets(content)
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(found), pa.string()), "position": pa.array(range(len(found)), pa.int32()),
                                                  "sheet": pa.array([s for s, _ in found], pa.string()), "member": pa.array([m for _, m in found], pa.string())})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, "path string, position int, sheet string, member string")


def read_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, position, row, cells) of one sheet by name, or of all: the rows that are not blank, as text."""
    listed = list_sheets(spark, path)
    listed = listed if sheet is None else listed.where(F.col("sheet") == sheet)
    contents = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, title, position, member, content in zip(*[c.to_pylist() for c in batch.columns]):
                numbers, cells = [], []
                for number, row in enumerate(rows(content, member)):
                    if row:
                        numbers.append(number)
                        cells.append(row)
                    if len(cells) == ROWS_A_BATCH:
                        yield _cells(name, title, position, numbers, cells)
                        numbers, cells = [], []
                yield _cells(name, title, position, numbers, cells)

    dealt = listed.join(contents, "path").select("path", "sheet", "position", "member", "content").repartition("path", "sheet")
    return dealt.mapInArrow(work, "path string, sheet string, position int, row long, cells array<string>")


def _cells(path: str, sheet: str, position: int, numbers: list[int], cells: list[list[str | None]]) -> pa.RecordBatch:
    n = len(cells)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([sheet] * n, pa.string()), pa.array([position] * n, pa.int32()),
                                       pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["path", "sheet", "position", "row", "cells"])


def _typed(cells: DataFrame, width: int) -> list[str]:
    """A type for each column: the narrowest that all its values are of."""
    def fits(c, kind):
        return F.count(F.when(c.isNotNull() & c.try_cast(kind).isNull(), 1)) == 0

    checks = []
    for i in range(width):
        c = F.get("cells", F.lit(i))
        whole = c.rlike(r"^[+-]?[0-9]+$")
        checks.append(F.when(F.count(c) == 0, "string").when(F.count(F.when(c.isNotNull() & ~c.isin("true", "false"), 1)) == 0, "boolean")
                      .when(fits(F.when(whole, c).otherwise(F.when(c.isNotNull(), "no")), "long"), "long").when(fits(c, "double"), "double")
                      .when(F.count(F.when(c.isNotNull() & ~c.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"), 1)) == 0, "timestamp").otherwise("string").alias(f"t{i}"))
    return list(cells.agg(*checks).first()) if width else []


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, infer: bool = True) -> DataFrame:
    """One sheet (the first, unless named) of the workbooks under ``path``, with the names of its first row and types found from the values.

    Workbooks under one path must have the same names in that row.
    """
    if sheet is None:
        first = list_sheets(spark, path).where("position = 0").select("sheet").distinct().collect()
        if len(first) != 1:
            raise ValueError(f"name a sheet: the first ones are called {[r.sheet for r in first]}")
        sheet = first[0].sheet
    cells = read_cells(spark, path, sheet)
    heads = cells.groupBy("path").agg(F.min(F.struct("row", "cells")).alias("h")).select("h.cells").distinct().limit(2).collect()
    if not heads:
        raise ValueError(f"no rows in sheet {sheet!r}")
    if len(heads) > 1:
        raise ValueError(f"sheet {sheet!r} has different columns in different files")
    names: list[str] = []
    for i, name in enumerate(heads[0].cells):
        name = name if name is not None else f"column_{i + 1}"
        names.append(name if name not in names else f"{name}_{i + 1}")
    top = cells.groupBy("path").agg(F.min("row").alias("top"))
    body = cells.join(F.broadcast(top), "path").where(F.col("row") > F.col("top"))
    kinds = _typed(body, len(names)) if infer else ["string"] * len(names)
    return body.select(*[F.get("cells", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(zip(names, kinds))])
