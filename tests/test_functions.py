"""Scalar functions: the grammar of amounts and dates, text clean-up, comparison."""

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from vouchlake.functions import compare, text
from vouchlake.functions.amounts import parse_amount
from vouchlake.functions.dates import parse_date, parse_short_date

AMOUNTS = {
    "1234.56": "1234.56", "1,234.56": "1234.56", "(1,234.56)": "-1234.56", "¥1,234.56": "1234.56", "CNY 1,234.56": "1234.56", "RMB1234": "1234", "-1,234.56": "-1234.56", "": None, "   ": None, "1000": "1000",
    "1.234.567": "1234567", "1.234.567,89": "123456789", "1,234,567.89": "1234567.89", "1.234,56": "1234.56", "1.234": "1.234", "1234,5": "1234.5", "1,234": "1234",
    "2024-01-15": "20240115", "nan": None, "-(100)": "-100", "¥(100)": "100", "100-": "100", "(-100)": "-100", "1e+16": "116", ".": None, "A100": "100", "（１００．５）": "-100.5", "usd 12": "12", "5.": "5", ".5": "0.5", None: None,
}
DATES = {
    "2024-01-15": date(2024, 1, 15), "2024/01/15": date(2024, 1, 15), "2024年01月15日": date(2024, 1, 15), "not a date": None, "": None, None: None, "2024.1.5": date(2024, 1, 5), "20240115": date(2024, 1, 15), "2024-1-5": date(2024, 1, 5),
    "03/04/2024": date(2024, 4, 3), "04/15/2024": date(2024, 4, 15), "2024-01-15 00:00:00": None, "2024115": date(2024, 11, 5), "202411": date(2024, 1, 1), "69-01-15": date(1969, 1, 15), "68-01-15": date(2068, 1, 15), "2024-02-30": None,
    "２０２４年１月５日": date(2024, 1, 5), "2024年1月5日下午": date(2024, 1, 5), "15-01-2024": date(2024, 1, 15), "15.01.2024": date(2024, 1, 15), "2024年13月1日": None, "2024-13-01": None,
}


def _apply(spark, values, use, schema="v string"):
    rows = [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)]
    return [r[1] for r in spark.createDataFrame(rows, f"i int, {schema}").select("i", use).orderBy("i").collect()]


def test_amounts(spark):
    got = _apply(spark, AMOUNTS, parse_amount(F.col("v")))
    assert got == [None if v is None else Decimal(v) for v in AMOUNTS.values()]


def test_dates(spark):
    assert _apply(spark, DATES, parse_date(F.col("v"))) == list(DATES.values())


def test_short_dates(spark):
    cases = {("4/8", "2024-04-20"): date(2024, 4, 8), ("2/30", "2024-03-01"): None, ("13/1", "2024-03-01"): None, ("2024-05-06", ""): date(2024, 5, 6), ("1月15日", "2024-01-20"): None, ("2/29", "2023/03/01"): None, ("", "2024-01-01"): None}
    assert _apply(spark, list(cases), parse_short_date(F.col("v"), F.col("r")), "v string, r string") == list(cases.values())


def test_clean_text(spark):
    cases = {"  hello   world  ": "hello world", "hello​world": "helloworld", None: "", "é（a）　b": "é(a) b", "a \n b": "a b"}
    assert _apply(spark, cases, text.clean_text(F.col("v"))) == list(cases.values())
    assert _apply(spark, ["ＡＢ１", None, "ﬁ"], text.nfkc(F.col("v"))) == ["AB1", "", "fi"]


def test_language_and_small_helpers(spark):
    assert _apply(spark, ["收入确认abc", "abc收", "", None], text.detect_language(F.col("v"))) == ["zh", "en", "en", "en"]
    assert _apply(spark, ["a" * 101, "ab", None], text.truncate_text(F.col("v"))) == ["a" * 100 + "...", "ab", ""]
    assert _apply(spark, ["A", "Z", "AA", "AC"], text.column_index(F.col("v"))) == [1, 26, 27, 29]
    assert _apply(spark, ["a.pdf", "a.PDF", "a.Pdf", "a.pdf.pdfx"], text.strip_pdf(F.col("v"))) == ["a", "a", "a.Pdf", "ax"]
    assert _apply(spark, ["matched", "other"], text.translate_key(F.col("v"), "en")) == ["Matched", "other"]


def test_similarity_is_twice_the_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + 1 if x == y else 0)
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert text.lcs_length(a, b) == plain(a, b)


def test_compare_amounts(spark):
    cases = {("100", "100"): (True, 1.0), ("100.01", "100"): (True, 1.0), ("1010", "1000"): (True, 1.0), ("1020", "1000"): (False, 0.98), ("5", "0"): (False, 1.0), ("x", "1"): (False, 0.0), ("1", "x"): (False, 0.0)}
    got = _apply(spark, list(cases), compare.compare_amounts(F.col("v"), F.col("e")), "v string, e string")
    assert [(r.matches, round(r.confidence, 6)) for r in got] == list(cases.values())
    assert got[3].difference == "20" and got[5].difference.startswith("N/A")


def test_compare_dates_and_texts(spark):
    cases = {("2024-01-15", "2024/01/15"): (True, 1.0), ("2024-01-15", "2024-01-18"): (True, 0.5), ("2024-01-15", "2024-01-19"): (False, round(1 - 4 / 6, 6)), ("x", "2024-01-15"): (False, 0.0)}
    got = _apply(spark, list(cases), compare.compare_dates(F.col("v"), F.col("e")), "v string, e string")
    assert [(r.matches, round(r.confidence, 6)) for r in got] == list(cases.values())
    exact = _apply(spark, [("2024-01-15", "2024-01-16")], compare.compare_dates(F.col("v"), F.col("e"), 0), "v string, e string")
    assert (exact[0].matches, exact[0].confidence) == (False, 0.0)
    texts = {("", None): (True, 1.0), ("a  b", "a b"): (True, 1.0), ("kitten", "sitting"): (False, round(8 / 13, 6))}
    got = _apply(spark, list(texts), compare.compare_text(F.col("v"), F.col("e")), "v string, e string")
    assert [(r.matches, round(r.confidence, 6)) for r in got] == list(texts.values())


def test_auto_compare_takes_iso_dates_for_numbers(spark):
    cases = [("20240115", "2024-03-01"), ("2024-01-15", "2024-03-01"), ("January", "Januar"), ("2024年1月5日", "x")]
    got = _apply(spark, cases, compare.auto_compare(F.col("v"), F.col("e")), "v string, e string")
    assert [r.matches for r in got] == [True, True, True, False]
    assert got[0].notes.startswith("Abs diff") and got[2].notes.startswith("Fuzzy") and "expected" in got[3].notes


def test_amounts_compared_in_a_step_of_their_own(spark):
    pairs = [("1.00", "1.005"), ("CNY 1,000.00", "1000"), ("900元", "¥900.0000"), ("x", "1"), ("1", "x"), (None, None), ("0", "0"), ("(5)", "-5"), ("1.5\n", "1.5")]
    df = spark.createDataFrame(pairs, "a string, b string")
    one = df.select("a", "b", compare.compare_amounts(F.col("a"), F.col("b")).alias("r")).select("a", "b", "r.*")
    other = compare.with_amounts_compared(df, F.col("a"), F.col("b"))
    assert other.columns == one.columns and sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))
    plan = other.select("matches", "difference")._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan  # fields that nobody reads are not computed
