"""Amounts written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize_fullwidth, strip

#: Digits with at most one point, behind a currency or before one character of it.
PLAIN = r"^(?:[$¥￥]|(?:CNY|RMB|USD) ?)?([0-9]+(?:\.[0-9]+)?)元?\z"


def parse_amount(text: Column, scale: int = 6) -> Column:
    """The amount that a text holds, as DECIMAL(38, scale); null if there is none.

    Parentheses around the whole text or a leading minus make it negative; currency signs and names go. Separators:
    several points, or several commas, group thousands; of one of each the last is the decimal point; a single
    comma is the decimal point if at most two characters follow it; a single point always is.
    """

    def body(s: Column) -> Column:
        brackets = s.startswith("(") & s.endswith(")")
        inner = F.when(brackets, strip(F.substring(s, 2, F.greatest(F.length(s) - 2, F.lit(0))))).otherwise(s)
        bare = strip(F.regexp_replace(F.regexp_replace(inner, "[$¥￥]", ""), r"(?iuU)(?:CNY|RMB|USD)\s*", ""))
        return let(bare, lambda b: signed(b, brackets))

    def signed(b: Column, brackets: Column) -> Column:
        minus = b.startswith("-")
        digits = F.when(minus, strip(F.substring(b, 2, F.length(b)))).otherwise(b)
        value = let(digits, separated)
        return F.when(brackets | minus, -value).otherwise(value)

    def separated(s: Column) -> Column:
        no_dots, no_commas = F.replace(s, F.lit(".")), F.replace(s, F.lit(","))
        dots, commas = F.length(s) - F.length(no_dots), F.length(s) - F.length(no_commas)
        tail = F.length(s) - F.instr(s, ",")
        plain = (
            F.when(dots > 1, no_dots)
            .when(commas > 1, no_commas)
            .when((dots == 1) & (commas == 1), F.when(F.instr(s, ".") > F.instr(s, ","), no_commas).otherwise(F.replace(no_dots, F.lit(","), F.lit("."))))
            .when((commas == 1) & (tail <= 2), F.replace(s, F.lit(","), F.lit(".")))
            .otherwise(no_commas)
        )
        return F.regexp_replace(plain, r"[^\p{Nd}.]", "").try_cast(f"decimal(38,{scale})")

    # an amount without separators of thousands needs no more than a cast; the rest goes the whole way
    plain = F.regexp_extract(text, PLAIN, 1)
    return F.when(plain != "", plain.try_cast(f"decimal(38,{scale})")).otherwise(let(strip(normalize_fullwidth(strip(text))), body))
