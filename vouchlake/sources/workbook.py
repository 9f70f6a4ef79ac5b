"""Workbooks (.xlsx): a Spark data source over the zipped XML, and a filler for result columns.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("sheet", "Sample").load("sample.xlsx")

Every column is text and named by its header (row 2, option ``header``), repeated or blank headers by their letter;
``row_idx`` counts data rows from 0. The data source opens local paths; :func:`read_workbook` reads through Spark.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def letters(n: int) -> str:
    """Column letters of a number from 1."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def number(cell: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", cell)[0]:
        out = out * 26 + ord(c) - 64
    return out


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name to its part, in the workbook's order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    part = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {s.get("name"): part(rels[s.get(_LINK)]) for s in root.iter(f"{_MAIN}sheet")}


def active_sheet(book: zipfile.ZipFile) -> int:
    """The place of the sheet that opens."""
    view = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}workbookView"), None)
    return min(int(view.get("activeTab") or 0) if view is not None else 0, len(sheets(book)) - 1)


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]


#: Built-in number formats that show a date.
_DATES = {*range(14, 18), 22, *range(27, 32), 36, *range(50, 59)}


def _date_styles(book: zipfile.ZipFile) -> tuple[set[int], date]:
    """The cell styles that show a date, and the day that counts as 0."""
    early = any(p.get("date1904") in ("1", "true") for p in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}workbookPr"))
    zero = date(1904, 1, 1) if early else date(1899, 12, 30)
    if "xl/styles.xml" not in book.namelist():
        return set(), zero
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    shows_day = lambda code: re.search("[yd]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())) is not None
    own = {int(n.get("numFmtId")): shows_day(n.get("formatCode") or "") for n in root.iter(f"{_MAIN}numFmt")}
    styles = root.find(f"{_MAIN}cellXfs")
    formats = [int(x.get("numFmtId") or 0) for x in styles] if styles is not None else []
    return {i for i, n in enumerate(formats) if own.get(n, n in _DATES)}, zero


def _day(value: str, zero: date) -> str:
    """A serial number as ``yyyy-MM-dd``; as it is, if it is none. (The format's 29 February 1900 shifts days before March 1900.)"""
    try:
        n = int(float(value))
        return (zero + timedelta(n + (zero.year == 1899 and n < 60))).isoformat()
    except (ValueError, OverflowError):
        return value


def read_rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, column number to text) of a sheet; numbers keep their digits as written, dates are ``yyyy-MM-dd``. Rows and cells without a reference follow the one before."""
    shared, (days, zero), at = _strings(book), _date_styles(book), 0
    with book.open(part) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            out, column, at = {}, 0, int(row.get("r") or at + 1)
            for c in row.iter(f"{_MAIN}c"):
                column = number(c.get("r")) if c.get("r") else column + 1
                v, kind = c.find(f"{_MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None:
                    continue
                else:
                    text = shared[int(v.text)] if kind == "s" else v.text
                    if kind in (None, "n") and int(c.get("s") or 0) in days:
                        text = _day(text, zero)
                out[column] = text
            yield at, out
            row.clear()


def write_workbook(table: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet; texts inline, None left out."""
    from xml.sax.saxutils import escape, quoteattr

    rows = []
    for r, values in enumerate(table, 1):
        cells = "".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for c, v in enumerate(values, 1) if v is not None)
        rows.append(f'<row r="{r}">{cells}</row>')
    space = "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>{"".join(rows)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def fill_workbook(original: bytes, values: dict[tuple[int, str], str], sheet: str | None = None) -> bytes:
    """The workbook with cells (row, letters) set to texts; the named sheet if there is one, else the active one. Everything else stays as it is."""
    source = zipfile.ZipFile(io.BytesIO(original))
    names = sheets(source)
    part = names.get(sheet) or list(names.values())[active_sheet(source)]
    ElementTree.register_namespace("", _MAIN[1:-1])
    root = ElementTree.fromstring(source.read(part))
    data = root.find(f"{_MAIN}sheetData")
    at = 0
    for row in data:  # rows and cells without a reference follow the one before
        at, column = int(row.get("r") or at + 1), 0
        row.set("r", str(at))
        for c in row.iter(f"{_MAIN}c"):
            column = number(c.get("r")) if c.get("r") else column + 1
            c.set("r", f"{letters(column)}{at}")
    rows = {int(r.get("r")): r for r in data}
    for (r, col), text in sorted(values.items(), key=lambda kv: (kv[0][0], number(kv[0][1]))):
        if r not in rows:
            rows[r] = ElementTree.SubElement(data, f"{_MAIN}row", {"r": str(r)})
        row = rows[r]
        cell = next((c for c in row if c.get("r") == f"{col}{r}"), None)
        if cell is None:
            cell = ElementTree.Element(f"{_MAIN}c", {"r": f"{col}{r}"})
            row.insert(sum(number(c.get("r")) < number(col) for c in row), cell)
        for child in list(cell):
            cell.remove(child)
        cell.set("t", "inlineStr")
        ElementTree.SubElement(ElementTree.SubElement(cell, f"{_MAIN}is"), f"{_MAIN}t").text = text
    data[:] = sorted(data, key=lambda x: int(x.get("r")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in source.infolist():
            z.writestr(item, ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True) if item.filename == part else source.read(item.filename))
    return out.getvalue()


def column_names(book: zipfile.ZipFile, part: str, header: int) -> list[str]:
    """A name for each column of a sheet: its header, or its letters where that is blank or was there before."""
    heads, width = {}, 0
    for r, cells in read_rows(book, part):
        width = max([width, *cells])
        if r == header:
            heads = cells
    out: list[str] = []
    for c in range(1, width + 1):
        name = (heads.get(c) or "").strip()
        out.append(name if name and name.lower() not in {"row_idx", *map(str.lower, out)} else letters(c))
    return out


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, header: int = 2) -> DataFrame:
    """The rows of a workbook on any file system that Spark reads, as :class:`WorkbookSource` gives those of a local one. The driver gets the column names only."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def opened(content) -> tuple[zipfile.ZipFile, str]:
        book = zipfile.ZipFile(io.BytesIO(bytes(content)))
        names = sheets(book)
        return book, names[sheet] if sheet else next(iter(names.values()))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame({"names": [column_names(*opened(content), header)]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                held = []
                for r, cells in read_rows(*opened(content)):
                    if r > header:
                        held.append((r - header - 1, [cells.get(c) for c in range(1, width + 1)]))
                    if len(held) == 1000:
                        yield pd.DataFrame(held, columns=["row_idx", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["row_idx", "cells"])

    names = files.mapInPandas(heads, "names array<string>").first().names
    width = len(names)
    return files.mapInPandas(rows, "row_idx long, cells array<string>").select("row_idx", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


class WorkbookSource(DataSource):
    """``workbook``: options ``path``, ``sheet`` (the first by default) and ``header`` (row of the headers, 2 by default)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _open(self) -> tuple[zipfile.ZipFile, str]:
        book = zipfile.ZipFile(self.options["path"])
        names = sheets(book)
        return book, names[self.options["sheet"]] if self.options.get("sheet") else next(iter(names.values()))

    def schema(self) -> StructType:
        book, part = self._open()
        names = column_names(book, part, int(self.options.get("header", 2)))
        return StructType([StructField("row_idx", LongType()), *[StructField(n, StringType()) for n in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, len(schema) - 1)


class _Reader(DataSourceReader):
    def __init__(self, source: WorkbookSource, width: int):
        self.source, self.width = source, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        book, part = self.source._open()
        first = int(self.source.options.get("header", 2)) + 1
        for r, cells in read_rows(book, part):
            if r >= first:
                yield (r - first, *[cells.get(c) for c in range(1, self.width + 1)])
