"""Typed comparison with tolerances: a struct of matches, confidence, both values, difference and notes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .amounts import parse_amount
from .dates import parse_date
from .text import clean_composed, let, levenshtein_ratio, render_decimal


def _result(matches, confidence, extracted: Column, expected: Column, difference, notes) -> Column:
    return F.struct(*_fields(matches, confidence, extracted, expected, difference, notes))


def _fields(matches, confidence, extracted: Column, expected: Column, difference, notes) -> list[Column]:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        as_column(matches).cast("boolean").alias("matches"), as_column(confidence).cast("double").alias("confidence"), F.coalesce(extracted, F.lit("")).alias("extracted_value"),
        F.coalesce(expected, F.lit("")).alias("expected_value"), as_column(difference).cast("string").alias("difference"), as_column(notes).alias("notes"),
    ]


def safe_decimal_compare(a: Column, b: Column, tolerance) -> Column:
    return F.abs(a - b) <= F.lit(tolerance)


def _parsed(text: Column) -> Column:
    return parse_amount(text, 4).cast("decimal(20,4)")


def _amounts(a: Column, e: Column, extracted: Column, expected: Column, tolerance: Decimal, tolerance_pct: Decimal) -> list[Column]:
    """The result's fields for both amounts."""
    gap = F.abs(a - e)
    share = F.when(e == 0, F.lit(0.0)).otherwise(gap.cast("double") / F.abs(e).cast("double") * 100)
    matches = (gap <= F.lit(tolerance)) | ((e != 0) & (gap <= F.lit(tolerance_pct) * F.abs(e)))
    notes = F.concat(F.lit("Abs diff: "), render_decimal(gap), F.lit(", Pct diff: "), F.format_string("%.2f", share), F.lit("%"))
    known = lambda unread, unknown, right: F.when(a.isNull(), unread).when(e.isNull(), unknown).otherwise(right)
    return _fields(
        known(False, False, matches), known(0.0, 0.0, F.when(matches, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - share / 100))), known(extracted, render_decimal(a), render_decimal(a)), known(expected, expected, render_decimal(e)),
        known("N/A - cannot parse extracted amount", "N/A - cannot parse expected amount", render_decimal(a - e)), known("Failed to parse extracted amount as a number", "Failed to parse expected amount as a number", notes),
    )


def compare_amounts(extracted: Column, expected: Column, tolerance: Decimal = Decimal("0.01"), tolerance_pct: Decimal = Decimal("0.01")) -> Column:
    """Equal within an absolute tolerance or a share of the expected amount (only the first, if that is 0)."""
    return let(F.struct(_parsed(extracted).alias("a"), _parsed(expected).alias("e")), lambda p: F.struct(*_amounts(p["a"], p["e"], extracted, expected, tolerance, tolerance_pct)))


def with_amounts_compared(df: DataFrame, extracted: Column, expected: Column, tolerance: Decimal = Decimal("0.01"), tolerance_pct: Decimal = Decimal("0.01")) -> DataFrame:
    """``df`` with the fields of :func:`compare_amounts` as columns: both texts are parsed in a step of their own, and only the fields that are read are computed."""
    texts = df.withColumns({"__x": extracted, "__y": expected})
    parsed = texts.withColumns({"__a": _parsed(F.col("__x")), "__e": _parsed(F.col("__y"))})
    return parsed.select(*df.columns, *_amounts(F.col("__a"), F.col("__e"), F.col("__x"), F.col("__y"), tolerance, tolerance_pct))


def compare_dates(extracted: Column, expected: Column, tolerance_days: int = 3) -> Column:
    """Equal within so many days; confidence falls to 0 at twice the tolerance (at once, if that is 0)."""

    def both(p: Column) -> Column:
        days = F.abs(F.datediff(p["a"], p["e"]))
        confidence = F.greatest(F.lit(0.0), 1 - days / (2.0 * tolerance_days)) if tolerance_days else F.when(days == 0, 1.0).otherwise(0.0)
        a, e = p["a"].cast("string"), p["e"].cast("string")
        notes = F.format_string(f"Date difference: %d days (tolerance: {tolerance_days})", days)
        right = _result(days <= tolerance_days, confidence, a, e, F.format_string("%d days", days), notes)
        unread = _result(False, 0.0, extracted, expected, "N/A - cannot parse extracted date", "Failed to parse extracted date")
        unknown = _result(False, 0.0, a, expected, "N/A - cannot parse expected date", "Failed to parse expected date")
        return F.when(p["a"].isNull(), unread).when(p["e"].isNull(), unknown).otherwise(right)

    return let(F.struct(parse_date(extracted).alias("a"), parse_date(expected).alias("e")), both)


def compare_text(extracted: Column, expected: Column, threshold: float = 0.8) -> Column:
    """Cleaned texts equal, or of a similarity of ``threshold`` at least."""
    a, e = clean_composed(extracted), clean_composed(expected)
    ratio = F.when(a == e, 1.0).otherwise(levenshtein_ratio(a, e))
    difference = F.when(a == e, "").otherwise(F.format_string("Similarity: %.1f%%", ratio * 100))
    notes = F.when((a == "") & (e == ""), "Both empty").when(a == e, "Exact match").otherwise(F.format_string(f"Fuzzy match ratio: %.3f (threshold: {threshold})", ratio))
    return _result(ratio >= threshold, ratio, a, e, difference, notes)


def auto_compare(extracted: Column, expected: Column, field_type: str = "auto", **options) -> Column:
    """By the type named; else as amounts if both sides hold one, as dates if the extracted side is one, else as texts. Options are those of the comparison that applies."""
    pick = lambda f, *names: f(extracted, expected, **{k: options[k] for k in names if k in options})
    amount = lambda: pick(compare_amounts, "tolerance", "tolerance_pct")
    date = lambda: pick(compare_dates, "tolerance_days")
    text = lambda: pick(compare_text, "threshold")
    if field_type != "auto":
        return {"amount": amount, "date": date, "text": text}[field_type]()
    numbers = parse_amount(extracted).isNotNull() & parse_amount(expected).isNotNull()
    return F.when(numbers, amount()).when(parse_date(extracted).isNotNull(), date()).otherwise(text())
