"""Decoded rows (:mod:`..sources.pdf`) to documents with text, tables, page types and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc
from . import layout
from .extraction import classify_documents

_PAGE = ["file_name", "page_number"]


def page_texts(rows: DataFrame) -> DataFrame:
    """``(file_name, page_number, page_type, text, warning)``: each page's type, and its native or OCR text as the type asks for; the best OCR mode counts."""
    pages = rows.where("kind = 'page'").select(*_PAGE, F.col("text").alias("native_text"), layout.page_type(F.col("text"), layout.image_ratio(F.col("image_area"), F.col("page_width"), F.col("page_height"))).alias("page_type"))
    words = rows.where("kind = 'word'").select(*_PAGE, "mode_no", "seq", "text", "conf")
    read = layout.ocr_pages(words, [*_PAGE, "mode_no"])
    best = layout.best_mode(read.select(*_PAGE, "mode_no", "confidence"), _PAGE).select(*_PAGE, "mode_no")
    read = read.join(best, [*_PAGE, "mode_no"]).select(*_PAGE, F.col("text").alias("ocr_text"), F.col("confidence").alias("ocr_confidence"))
    return layout.route_text(pages.join(read, _PAGE, "left")).select(*_PAGE, "page_type", "text", "warning")


def table_cells(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``(file_name, table_idx, row_idx, col_idx, header, value)``: cells of ruled tables, and of tables by position on scanned pages. Tables are numbered by page and place: page * 1000 + number."""
    number = (F.col("page_number") * 1000 + F.coalesce("table_idx", F.lit(0))).alias("table_idx")
    ruled = rows.where("kind = 'cell'").select("file_name", number, "row_idx", "col_idx", "text")
    line = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda c: c["text"])
    ruled = ruled.groupBy("file_name", "table_idx", F.col("row_idx").alias("row_no")).agg(line.alias("cells"))
    scanned = pages.where("page_type = 'scanned'").select(*_PAGE)
    spans = rows.where("kind = 'span'").join(scanned, _PAGE, "left_semi").select(*_PAGE, "seq", "text", "x0", "y0")
    placed = layout.positional_tables(spans, _PAGE).select("file_name", (F.col("page_number") * 1000).alias("table_idx"), "row_no", "cells")
    return layout.grid_cells(ruled.unionByName(placed), ["file_name", "table_idx"])


def documents(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``(file_name, doc_seq, full_text, page_types, warnings)`` for the files of ``order(file_name, doc_seq)``: pages in order, a page that failed has the type error; files without pages have an empty text."""
    pages = page_texts(rows)
    failed = rows.where("kind = 'warning' and page_number is not null").select(*_PAGE, F.lit("error").alias("page_type"))
    types = layout.document_page_types(pages.select(*_PAGE, "page_type").unionByName(failed).withColumnRenamed("file_name", "doc_id")).withColumnRenamed("doc_id", "file_name")
    texts = layout.full_text(pages, "file_name")
    said = rows.where("kind = 'warning'").select(*_PAGE, F.col("text").alias("warning")).unionByName(pages.where("warning is not null").select(*_PAGE, "warning"))
    warnings = said.groupBy("file_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "warning"))), lambda w: w["warning"]).alias("warnings"))
    out = order.join(texts, "file_name", "left").join(types, "file_name", "left").join(warnings, "file_name", "left")
    empty = F.array().cast("array<string>")
    return out.select("file_name", "doc_seq", nfc(F.coalesce("full_text", F.lit(""))).alias("full_text"), F.coalesce("page_types", empty).alias("page_types"), F.coalesce("warnings", empty).alias("warnings"))


def classified(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Decoded rows to classified documents with their fields, those of tables included: what :func:`.matching.assign_first` takes."""
    return classify_documents(documents(rows, order), table_cells(rows, page_texts(rows)))
