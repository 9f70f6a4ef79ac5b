"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DATA_ROW, SHEET_COLUMNS
from ..operators.report import OUTPUTS
from .workbook import fill_workbook, letters


#: Rows that a sheet of the file format has below its headers.
SHEET_ROWS = (1 << 20) - DATA_ROW + 1


def write_summary_csv(summary: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with headings; with a byte order mark in front of the first heading, so that spreadsheets read it as UTF-8."""
    names = summary.columns
    out = summary.withColumnRenamed(names[0], "﻿" + names[0]) if bom else summary
    out.write.mode("overwrite").option("header", "true").csv(path)


def fill_sheet(original: bytes, results: DataFrame, sheet: str | None = None, max_rows: int = SHEET_ROWS) -> bytes:
    """The workbook with columns R to AC filled from ``results(row_idx, ...)``. A sheet's rows pass the driver: more than ``max_rows`` (what a sheet can hold below its headers) are refused."""
    at = {n: letters(SHEET_COLUMNS.index(n) + 1) for n in OUTPUTS}
    rows = results.select("row_idx", *OUTPUTS).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    values = {(DATA_ROW + r.row_idx, at[n]): r[n] for r in rows for n in OUTPUTS if r[n] is not None}
    return fill_workbook(original, values, sheet)
