"""Pages, blocks and tables from page metrics, text spans and OCR words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.text import count_cjk_chars, let, strip


def image_ratio(image_area: Column, width: Column, height: Column) -> Column:
    return F.when(width * height > 0, F.coalesce(image_area, F.lit(0.0)) / (width * height)).otherwise(0.0)


def page_type(text: Column, ratio: Column) -> Column:
    """native, scanned or mixed: by enough text (CJK pages need less) and a dominant image."""
    chars, cjk = F.coalesce(F.length(strip(text)), F.lit(0)), count_cjk_chars(text)
    enough = (chars >= CONFIG.native_min_chars) | (cjk >= CONFIG.native_min_cjk)
    image = ratio >= CONFIG.scanned_image_ratio
    return F.when(enough & ~image, "native").when(~enough & image, "scanned").when(enough, "mixed").when((chars < CONFIG.empty_max_chars) & (cjk < CONFIG.empty_max_cjk), "scanned").otherwise("native")


def document_page_types(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_types)``: the types of a document's pages in order; takes ``pages(doc_id, page_number, page_type)``."""
    return pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_type"))), lambda p: p["page_type"]).alias("page_types"))


def block_type(y0: Column, page_height: Column) -> Column:
    """header in the top twentieth of a page, footer in the bottom one, else paragraph."""
    ratio = F.when(page_height > 0, y0 / page_height).otherwise(0.5)
    return F.when(ratio < 0.05, "header").when(ratio > 0.95, "footer").otherwise("paragraph")


def route_text(pages: DataFrame) -> DataFrame:
    """``pages(page_type, native_text, ocr_text, ocr_confidence, ...)`` with ``text`` and ``warning``: OCR for scanned pages, and for mixed ones without native text."""
    native = F.coalesce("native_text", F.lit(""))
    text = F.when(F.col("page_type") == "scanned", F.coalesce("ocr_text", F.lit(""))).when((F.col("page_type") == "mixed") & (native == ""), F.coalesce("ocr_text", F.lit(""))).otherwise(native)
    low = F.col("page_type").isin("scanned", "mixed") & (F.coalesce("ocr_confidence", F.lit(0.0)) < CONFIG.ocr_warn_below)
    shown = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(": Low OCR confidence ("), F.bround(F.coalesce("ocr_confidence", F.lit(0.0)) * 100, 0).cast("int").cast("string"), F.lit("%), manual review recommended"))
    return pages.withColumns({"text": text, "warning": F.when(low, shown)})


def full_text(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """``(doc, full_text)``: a document's pages in order, with a blank line between."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("full_text"))


# tables -----------------------------------------------------------------------------------------------------------


def snap(x: Column, grid: float = CONFIG.column_grid) -> Column:
    """To the grid, halves to the even line."""
    return F.bround(x / grid) * grid


def detect_columns(starts: Column, grid: float = CONFIG.column_grid) -> Column:
    """Column positions: the distinct snapped starts in order, without those within a grid step of the last one kept."""
    ordered = F.array_sort(F.array_distinct(F.transform(starts, lambda x: snap(x, grid))))
    return F.aggregate(ordered, F.array().cast("array<double>"), lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(x - F.try_element_at(a, F.lit(-1)) > grid, F.concat(a, F.array(x))).otherwise(a))


def nearest_column(x0: Column, columns: Column, reach: float = CONFIG.column_reach) -> Column:
    """Index of the nearest column, the first of equals; null if none is within reach."""
    best = F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(x0 - c).alias("d"), i.alias("i"))))
    return F.when(best["d"] < reach, best["i"])


def cluster_rows(spans: DataFrame, keys: list[str], tolerance: float = CONFIG.row_tolerance) -> DataFrame:
    """``spans(keys, seq, y0, ...)`` with ``row_no`` from 0: a span joins the row whose first span is at most ``tolerance`` above it.

    Rows hang on their first span, not on the span before: a fold over a page's distinct heights keeps one anchor a
    row, and each span takes the last anchor that isn't below it. Spans without a height have no row.
    """
    heights = F.array_sort(F.collect_set("y0"))
    fold = F.aggregate(heights, F.array().cast("array<double>"), lambda a, y: F.when((F.size(a) == 0) | (y - F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) > tolerance), F.concat(a, F.array(y))).otherwise(a))
    anchors = spans.groupBy(*keys).agg(fold.alias("a")).select(*keys, F.posexplode("a").alias("row_no", "y0")).withColumn("__span", F.lit(False))
    rows = spans.withColumn("seq", F.col("seq").cast("bigint")).withColumn("__span", F.lit(True)).unionByName(anchors, allowMissingColumns=True)
    above = Window.partitionBy(*keys).orderBy("y0", "__span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("row_no", F.last("row_no", ignorenulls=True).over(above)).where("__span").drop("__span")


def positional_tables(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, row_no, cells)``: grids of pages with four spans, two rows and two columns at least; texts of one cell are joined by a space, in the order of x0 and seq."""
    clean = spans.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    rows = cluster_rows(clean, keys)
    page = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("row_no").alias("last"), detect_columns(F.collect_list("x0")).alias("columns")).where((F.col("n") >= 4) & (F.col("last") >= 1) & (F.size("columns") >= 2))
    placed = rows.join(page.select(*keys, "columns"), keys).withColumn("col_no", nearest_column(F.col("x0"), F.col("columns")))
    cells = placed.groupBy(*keys, "row_no").agg(F.first("columns").alias("columns"), F.array_sort(F.collect_list(F.struct("x0", "seq", "col_no", "text"))).alias("s"))
    grid = F.transform("columns", lambda c, i: F.array_join(F.transform(F.filter("s", lambda s: s["col_no"] == i), lambda s: s["text"]), " "))
    return cells.select(*keys, "row_no", grid.alias("cells"))


def unique_headers(headers: Column) -> Column:
    """Blank headers become ``Column``; the n-th repetition of a name gets ``_n``.

    Names are sorted with their places, so that equal ones are neighbours and a run's places count up: n log n in a
    table's width.
    """
    named = F.transform(headers, lambda h: F.when(F.coalesce(strip(h), F.lit("")) == "", "Column").otherwise(strip(h)))
    placed = F.sort_array(F.transform(named, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def numbered(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, j: j), lambda j: (j == 0) | (F.element_at(s, F.greatest(j, F.lit(1)))["h"] != F.element_at(s, j + 1)["h"]))
        return let(begins, lambda b: F.flatten(F.transform(b, lambda j, r: run(F.slice(s, j + 1, F.coalesce(F.try_element_at(b, r + 2), F.size(s)) - j)))))

    run = lambda same: F.transform(same, lambda x, n: F.struct(x["i"].alias("i"), F.when(n > 0, F.concat(x["h"], F.lit("_"), n.cast("string"))).otherwise(x["h"]).alias("h")))
    return F.transform(F.sort_array(let(placed, numbered)), lambda x: x["h"])


def fit_row(row: Column, width: Column) -> Column:
    """A row padded with empty cells, or cut, to the header's width; null cells become empty, others are stripped."""
    return F.slice(F.concat(F.transform(row, lambda c: F.coalesce(strip(c), F.lit(""))), F.array_repeat(F.lit(""), width)), F.lit(1), width)


def grid_cells(grids: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, row_idx, col_idx, header, value)`` from ``grids(keys, row_no, cells)``: the first row has the headers; grids of one row are no tables."""
    heads = grids.where("row_no = 0").select(*keys, unique_headers(F.col("cells")).alias("heads"))
    body = grids.where("row_no > 0").join(heads, keys)
    cells = body.select(*keys, (F.col("row_no") - 1).alias("row_idx"), F.posexplode(F.arrays_zip(F.col("heads").alias("header"), fit_row(F.col("cells"), F.size("heads")).alias("value"))).alias("col_idx", "c"))
    return cells.select(*keys, "row_idx", "col_idx", "c.header", "c.value")


def table_confidence(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, confidence)`` by the share r of cells that are not empty: 0.3 below 0.3, else 0.8 r + 0.2."""
    r = F.avg(F.when(F.coalesce("value", F.lit("")) != "", 1.0).otherwise(0.0))
    return cells.groupBy(*keys).agg(F.when(r < 0.3, 0.3).otherwise(F.least(F.lit(1.0), r * 0.8 + 0.2)).alias("confidence"))


# OCR words --------------------------------------------------------------------------------------------------------


def ocr_blocks(words: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, block_no, content, confidence)`` from ``words(keys, seq, text, conf)``: an empty word ends a block; words without confidence are left out."""
    page = Window.partitionBy(*keys).orderBy("seq")
    text = strip(F.coalesce("text", F.lit("")))
    marked = words.select(*keys, "seq", text.alias("text"), "conf", F.sum(F.when(text == "", 1).otherwise(0)).over(page).alias("part"))
    blocks = marked.where("text <> '' and conf > 0").groupBy(*keys, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]), " ").alias("content"), clamp(F.avg("conf")).alias("confidence"))
    return blocks.withColumn("block_no", F.row_number().over(Window.partitionBy(*keys).orderBy("part")) - 1).drop("part")


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence / 100.0))


def ocr_pages(words: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, text, confidence)``: blocks by line, and the mean confidence of all kept words (0 if none)."""
    blocks = ocr_blocks(words, keys).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "content"))), lambda b: b["content"]), "\n").alias("text"))
    mean = words.groupBy(*keys).agg(F.coalesce(clamp(F.avg(F.when((strip(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") > 0), F.col("conf")))), F.lit(0.0)).alias("confidence"))
    return mean.join(blocks, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def best_mode(runs: DataFrame, keys: list[str], good_enough: float = CONFIG.ocr_good_enough) -> DataFrame:
    """``(keys, mode_no, confidence)`` from ``runs(keys, mode_no, confidence)``: the best of the modes tried, the earlier of equals; modes behind the first that is good enough are not tried."""
    good = F.min(F.when(F.col("confidence") >= good_enough, F.col("mode_no"))).over(Window.partitionBy(*keys))
    tried = runs.withColumn("__good", good).where(F.col("__good").isNull() | (F.col("mode_no") <= F.col("__good")))
    best = F.max_by(F.struct("mode_no", "confidence"), F.struct("confidence", -F.col("mode_no")))
    return tried.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.mode_no", "b.confidence")
