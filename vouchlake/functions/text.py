"""Text normalisation and comparison."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..config import TEXTS


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: All white space of Unicode, and the ASCII separators.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(s, F.lit(WHITE))


#: Full-width characters, and what stands for them.
FULLWIDTH = ("，．－（）：；　", ",.-():; ")


def normalize_fullwidth(s: Column) -> Column:
    """Full-width punctuation and the ideographic space to ASCII; null to empty."""
    return F.translate(F.coalesce(s, F.lit("")), *FULLWIDTH)


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _non_ascii(s: Column) -> Column:
    return F.when(s.rlike(r"[^\x00-\x7F]"), s)


def nfc(s: Column) -> Column:
    """Canonical composition. There is no built-in function; only rows that are not ASCII reach the Arrow function."""
    return F.coalesce(_nfc(_non_ascii(s)), s)


def nfkc(s: Column) -> Column:
    """Compatibility composition (also what corrects common OCR confusions of full-width characters); null to empty."""
    return F.coalesce(_nfkc(_non_ascii(s)), s, F.lit(""))


fix_ocr_common_errors = nfkc


def clean_composed(s: Column) -> Column:
    """:func:`clean_text` of text that is in NFC already: native throughout."""
    s = F.translate(F.coalesce(s, F.lit("")), FULLWIDTH[0] + "\u200b\u200c\u200d\ufeff", FULLWIDTH[1])
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def clean_text(s: Column) -> Column:
    """NFC, without zero-width characters, full-width punctuation folded, white space collapsed and stripped; null to empty."""
    return clean_composed(nfc(s))


def count_cjk_chars(s: Column) -> Column:
    return F.coalesce(F.regexp_count(s, F.lit("[一-鿿]")), F.lit(0))


def detect_language(s: Column) -> Column:
    """``zh`` if there are more CJK characters than ASCII letters, else ``en``."""
    return F.when(count_cjk_chars(s) > F.coalesce(F.regexp_count(s, F.lit("[A-Za-z]")), F.lit(0)), "zh").otherwise("en")


def truncate_text(s: Column, max_length: int = 100) -> Column:
    return F.when(F.length(s) > max_length, F.concat(F.substring(s, 1, max_length), F.lit("..."))).otherwise(F.coalesce(s, F.lit("")))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        match = row & where.get(c, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def _indel(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else 1.0 if not x and not y else 2.0 * lcs_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Twice the longest common subsequence over both lengths (a replacement costs two edits); null if either is null."""
    return _indel(a, b)


def translate_key(key: Column, lang: str = "zh") -> Column:
    """The interface text of a key in a language; Chinese for other languages, the key itself if it is unknown."""
    at = 1 if lang == "en" else 0
    texts = F.create_map(*[F.lit(x) for k, v in TEXTS.items() for x in (k, v[at])])
    return F.coalesce(F.try_element_at(texts, key), key)


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters to a number: A is 1, AA is 27."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def strip_pdf(name: Column) -> Column:
    """Without ``.pdf`` and ``.PDF``, wherever they stand."""
    return F.replace(F.replace(name, F.lit(".pdf")), F.lit(".PDF"))


def file_label(size: Column) -> Column:
    return F.format_string("%.1f KB", size / 1024.0)


def render_decimal(d: Column) -> Column:
    """A decimal as text without trailing zeros."""
    s = d.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
