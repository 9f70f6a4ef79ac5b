"""PDF documents to rows: pages, text blocks, spans, ruled tables and OCR words.

Decoding needs optional libraries (PyMuPDF, pdfplumber, pytesseract with Pillow). What is missing yields no rows of
its kind; a file that cannot be opened yields one warning row and never fails a job. Everything behind these
rows is relational (:mod:`..operators.layout`).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..operators.images import clean_image

try:
    import fitz
except ImportError:
    fitz = None
try:
    import pdfplumber
except ImportError:
    pdfplumber = None
try:
    import pytesseract
    from PIL import Image
except ImportError:
    pytesseract = None

#: One row for each thing found; ``kind`` is page, block, span, cell, word or warning.
SCHEMA = (
    "file_name string, kind string, page_number int, seq int, text string, x0 double, y0 double, x1 double, y1 double, "
    "page_width double, page_height double, image_area double, mode_no int, conf double, table_idx int, row_idx int, col_idx int"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _row(file_name: str, kind: str, page: int | None = None, **values) -> dict:
    return {"file_name": file_name, "kind": kind, "page_number": page, **values}


def _spans(page) -> Iterator[tuple[str, tuple]]:
    for block in page.get_text("dict").get("blocks", []):
        if block.get("type") == 0:
            for line in block.get("lines", []):
                for span in line.get("spans", []):
                    yield span.get("text", ""), tuple(span.get("bbox", (0, 0, 0, 0)))


def _blocks(page) -> Iterator[tuple[str, tuple]]:
    for block in page.get_text("dict").get("blocks", []):
        if block.get("type") == 0:
            lines = ["".join(s.get("text", "") for s in line.get("spans", [])) for line in block.get("lines", [])]
            text = "\n".join(x for x in lines if x.strip()).strip()
            if text:
                yield text, tuple(block["bbox"])


def _tables(page) -> Iterator[list]:
    """Ruled tables; those aligned by text if there are none. A strategy that fails finds none."""
    for strategy in ("lines", "text"):
        try:
            got = [t for t in page.extract_tables({"vertical_strategy": strategy, "horizontal_strategy": strategy, "snap_tolerance": CONFIG.table_snap, "join_tolerance": CONFIG.table_join}) or [] if t]
        except Exception:  # noqa: S112
            continue
        if got:
            yield from got
            return


def _read_words(image, mode: int) -> tuple[list[tuple[str, float]], float]:
    """(word, confidence) of one OCR mode and their mean confidence (0 to 1); the plain text as one word of 50 where words can't be had."""
    config = f"--oem 3 --psm {mode}"
    try:
        data = pytesseract.image_to_data(image, lang=CONFIG.ocr_language, config=config, output_type=pytesseract.Output.DICT)
    except Exception:
        try:
            return [(pytesseract.image_to_string(image, lang=CONFIG.ocr_language, config=config), 50.0)], 0.5
        except Exception:
            return [], 0.0
    words = [(t.strip(), float(c)) for t, c in zip(data["text"], data["conf"], strict=True)]
    kept = [c for t, c in words if t and c > 0]
    return words, sum(kept) / len(kept) / 100 if kept else 0.0


def _words(page) -> Iterator[tuple[int, int, str, float]]:
    """(mode, number, word, confidence) for each OCR mode until one is good enough; none if the page can't be drawn."""
    scale = CONFIG.image_dpi / 72
    try:
        image = Image.open(io.BytesIO(page.get_pixmap(matrix=fitz.Matrix(scale, scale)).tobytes("png")))
    except Exception:
        return
    cleaned = clean_image(np.array(image))
    image = Image.fromarray(cleaned) if cleaned.ndim == 2 else image
    for k, mode in enumerate(CONFIG.ocr_modes):
        words, mean = _read_words(image, mode)
        yield from ((k, i, t, c) for i, (t, c) in enumerate(words))
        if mean >= CONFIG.ocr_good_enough:
            return


def _kind(text: str, ratio: float) -> str:
    """The page type as :func:`..operators.layout.page_type` gives it; decides here what is worth drawing and reading."""
    chars, cjk = len(text.strip()), sum("\u4e00" <= c <= "\u9fff" for c in text)
    enough, image = chars >= CONFIG.native_min_chars or cjk >= CONFIG.native_min_cjk, ratio >= CONFIG.scanned_image_ratio
    if enough:
        return "mixed" if image else "native"
    return "scanned" if image or (chars < CONFIG.empty_max_chars and cjk < CONFIG.empty_max_cjk) else "native"


def _ruled(content: bytes):
    try:
        return pdfplumber.open(io.BytesIO(content)) if pdfplumber else None
    except Exception:  # tables are an extra
        return None


def decode(file_name: str, content: bytes, ocr: bool) -> Iterator[dict]:
    """The rows of one file. Only scanned and mixed pages are read by OCR, only native and mixed ones searched for ruled tables."""
    if fitz is None:
        yield _row(file_name, "warning", text="Failed to open PDF: no decoder")
        return
    try:
        doc = fitz.open(stream=content, filetype="pdf")
    except Exception as e:  # a broken file is a result
        yield _row(file_name, "warning", text=f"Failed to open PDF: {e}")
        return
    ruled = _ruled(content)
    try:
        for k in range(len(doc)):
            try:
                yield from list(_page(file_name, doc[k], k, ruled, ocr))
            except Exception as e:  # so is a broken page
                yield _row(file_name, "warning", k + 1, text=f"Page {k + 1}: Processing error - {e}")
    finally:
        for x in (doc, ruled):
            if x is not None:
                x.close()


def _page(file_name: str, page, k: int, ruled, ocr: bool) -> Iterator[dict]:
    n, text = k + 1, page.get_text("text") or ""
    width, height = page.rect.width, page.rect.height
    area = float(sum(r.width * r.height for i in page.get_images(full=True) for r in page.get_image_rects(i[0])))
    kind = _kind(text, area / (width * height) if width * height > 0 else 0.0)
    yield _row(file_name, "page", n, text=text, page_width=width, page_height=height, image_area=area)
    for what, found in (("block", _blocks(page)), ("span", _spans(page))):
        for i, (value, box) in enumerate(found):
            yield _row(file_name, what, n, seq=i, text=value, x0=box[0], y0=box[1], x1=box[2], y1=box[3], page_height=height)
    if ocr and pytesseract is not None and kind != "native":
        for mode, i, value, conf in _words(page):
            yield _row(file_name, "word", n, seq=i, text=value, mode_no=mode, conf=conf)
    try:
        tables = list(_tables(ruled.pages[k])) if ruled is not None and kind != "scanned" else []
    except Exception:  # a page that has text but no tables
        tables = []
    for t, table in enumerate(tables):
        for r, cells in enumerate(table):
            for c, value in enumerate(cells):
                yield _row(file_name, "cell", n, text=(value or "").strip(), table_idx=t, row_idx=r, col_idx=c)


def process_pdfs(files: DataFrame, ocr: bool = True) -> DataFrame:
    """Rows of SCHEMA for ``files(path, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(decode(path.rsplit("/", 1)[-1], bytes(content or b""), ocr))
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=_COLUMNS).astype({c: "Int64" for c in ("page_number", "seq", "mode_no", "table_idx", "row_idx", "col_idx")})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def pages(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == "page").select(F.col("file_name").alias("doc_id"), "page_number", F.col("text").alias("native_text"), "page_width", "page_height", "image_area")
