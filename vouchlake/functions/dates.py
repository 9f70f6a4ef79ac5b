"""Dates written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_composed, let, normalize_fullwidth, strip

_M, _D, _Y = r"(1[0-2]|0[1-9]|[1-9])", r"(3[01]|[12]\d|0[1-9]|[1-9])", r"(\d{4})"
#: Layouts in order of precedence: pattern, groups of year, month, day.
_LAYOUTS = (
    (rf"^{_Y}-{_M}-{_D}$", (1, 2, 3)),
    (rf"^{_Y}/{_M}/{_D}$", (1, 2, 3)),
    (rf"^{_Y}\.{_M}\.{_D}$", (1, 2, 3)),
    (rf"^{_Y}{_M}{_D}$", (1, 2, 3)),
    (rf"^{_D}/{_M}/{_Y}$", (3, 2, 1)),
    (rf"^{_M}/{_D}/{_Y}$", (3, 1, 2)),
    (rf"^{_D}-{_M}-{_Y}$", (3, 2, 1)),
    (rf"^{_D}\.{_M}\.{_Y}$", (3, 2, 1)),
)
_CHINESE = r"^(\d{4})年(\d{1,2})月(\d{1,2})日?"
_SHORT_YEAR = rf"^(\d{{2}})-{_M}-{_D}$"


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d")


def _matched(s: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    return F.when(s.rlike(pattern), _date(*[F.regexp_extract(s, pattern, g) for g in groups]))


def parse_date(text: Column) -> Column:
    """The date that a text is, or null. ``2024年1月5日`` counts also with more text behind it; day before month where both fit; years of two digits from 69 on are of the 1900s.

    Full-width digits and punctuation are folded; text in other compatibility forms has to pass ``nfkc`` first.
    """

    def read(s: Column) -> Column:
        century = F.when(F.regexp_extract(s, _SHORT_YEAR, 1) >= "69", "19").otherwise("20")
        short = F.when(s.rlike(_SHORT_YEAR), _date(F.concat(century, F.regexp_extract(s, _SHORT_YEAR, 1)), F.regexp_extract(s, _SHORT_YEAR, 2), F.regexp_extract(s, _SHORT_YEAR, 3)))
        return F.coalesce(_matched(s, _CHINESE, (1, 2, 3)), *[_matched(s, p, g) for p, g in _LAYOUTS], short)

    return let(normalize_fullwidth(F.translate(strip(text), "０１２３４５６７８９／", "0123456789/")), read)


def parse_short_date(text: Column, reference: Column) -> Column:
    """:func:`parse_date`; else ``M/D`` in the year of the reference date (this year, if that is no date)."""
    short = r"^(\d{1,2})/(\d{1,2})$"

    def read(s: Column) -> Column:
        year = F.year(F.coalesce(parse_date(reference), F.current_date()))
        return F.when(s.rlike(short), _date(year.cast("string"), F.regexp_extract(s, short, 1), F.regexp_extract(s, short, 2)))

    return F.coalesce(parse_date(text), let(clean_composed(text), read))
