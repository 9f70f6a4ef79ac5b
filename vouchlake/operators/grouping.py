"""Sample rows to delivery groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COLLIDING, HINTS, INPUT_COLUMNS
from ..functions.amounts import parse_amount
from ..functions.text import strip

MONEY = "decimal(20,4)"


def resolve_columns(columns: list[str], hints: Mapping[str, tuple[str, int]] = HINTS, by_hint: bool = False) -> dict[str, str]:
    """Logical name to sheet column: the first header that contains the attribute's word, and by position if none does. Positions beyond the sheet are left out.

    The words of COLLIDING attributes stand in headers of others as well; these go by position, unless ``by_hint``.
    """
    out = {}
    for name, (word, position) in hints.items():
        found = next((c for c in columns if word in c), None) if by_hint or name not in COLLIDING else None
        if found or position < len(columns):
            out[name] = found or columns[position]
    return out


def read_sample(sheet: DataFrame, by_hint: bool = False) -> DataFrame:
    """A sheet's rows under logical names, all text (typed dates as ``yyyy-MM-dd``); ``row_idx`` is kept or has to be there."""
    names = resolve_columns([c for c in sheet.columns if c != "row_idx"], by_hint=by_hint)
    kinds = dict(sheet.dtypes)
    value = lambda c: F.date_format(c, "yyyy-MM-dd") if kinds[c].startswith(("date", "timestamp")) else F.col(f"`{c}`").cast("string")
    return sheet.select("row_idx", *[value(c).alias(n) for n, c in names.items()])


def delivery_groups(rows: DataFrame) -> DataFrame:
    """A row for each delivery note of ``rows(row_idx, delivery_no, ...)``.

    Null, blank and ``nan`` keys are left out; keys that differ in outer white space are different groups. Texts and the
    unit price are those of the first row, the quantity is the number of rows, revenues are sums of the amounts
    that can be read. One aggregation, combined before its shuffle; missing texts are empty.
    """
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit("")).alias(c)
    first = F.min_by(F.struct(text("customer"), text("material_name"), text("spec_model"), "unit_price", text("delivery_date"), text("confirm_date")), "row_idx")
    total = lambda c: F.coalesce(F.sum(parse_amount(F.col(c), 4).cast(MONEY)), F.lit(0)).cast(MONEY)
    key = strip(F.col("delivery_no"))
    return (
        rows.where(F.col("delivery_no").isNotNull() & (key != "") & (key != "nan"))
        .groupBy(F.col("delivery_no").alias("raw_key"))
        .agg(first.alias("f"), F.min("row_idx").alias("first_row"), F.array_sort(F.collect_list("row_idx")).alias("row_indices"), F.count("*").alias("total_qty"), total("revenue_tax").alias("total_revenue_tax"), total("revenue_notax").alias("total_revenue_notax"))
        .select(strip(F.col("raw_key")).alias("delivery_no"), "first_row", "row_indices", F.col("f.customer").alias("customer_name"), "f.material_name", "f.spec_model", parse_amount(F.col("f.unit_price"), 4).cast(MONEY).alias("unit_price"), "total_qty", "total_revenue_tax", "total_revenue_notax", "f.delivery_date", "f.confirm_date")
    )


def delivery_numbers(rows: DataFrame) -> DataFrame:
    """``(delivery_no)`` of the groups that :func:`delivery_groups` gives, from ``rows(delivery_no)`` alone."""
    raw, key = rows.select("delivery_no").distinct(), strip(F.col("delivery_no"))
    return raw.where((key != "") & (key != "nan")).select(key.alias("delivery_no"))


def preview(groups: DataFrame) -> DataFrame:
    """What the group list shows."""
    return groups.select("delivery_no", "customer_name", "material_name", F.size("row_indices").alias("n_rows"), "total_qty", F.col("total_revenue_tax").cast("string").alias("total_revenue_tax"))


def head(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first rows of a sheet."""
    return rows.orderBy("row_idx").limit(n)


__all__ = ["INPUT_COLUMNS", "delivery_groups", "delivery_numbers", "head", "preview", "read_sample", "resolve_columns"]
