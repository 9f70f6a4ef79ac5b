"""Registered queries against their DuckDB twins on the smallest tables."""

import dataclasses
import os
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from vouchlake.operators import extraction, grouping, matching
from vouchlake.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
#: Queries that share their whole plan with another one here are left to the correctness run.
SHARED = {"check1_contract", "check2_delivery", "check3_amount", "check4_timing", "check5_signer", "attachment_index", "pass_rate", "per_check_table", "group_preview", "matched_count", "match_direct"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    plain = [repr(tuple(None if x is None or x != x else x for x in r)) for r in pdf.itertuples(index=False, name=None)]
    return sorted(re.sub(r"datetime\.date\((\d+), (\d+), (\d+)\)|Timestamp\('(\d+)-(\d+)-(\d+) 00:00:00'\)", lambda m: "-".join(str(int(x)) for x in m.groups() if x), r) for r in plain)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SHARED))
def test_query(spark, duck, name):
    got, want = registry.queries()[name](spark, str(DATA)).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_point_works_without_the_corpus_modules(spark, monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("vouchlake.llm", "corpus_pipeline") else find(name, *a))
    assert set(__spark_entry__.queries()) == set(registry.queries())


def test_texts_are_compared_on_whole_rows(spark):
    rows = registry.compare_text(spark, str(DATA)).collect()
    assert len(rows) == 200 and all(0 <= r.confidence <= 1 for r in rows)


def test_amount_check_reads_groups_only(spark, duck, monkeypatch):
    def refuse(*a):
        raise AssertionError("documents are not needed")

    monkeypatch.setattr(registry.demo, "documents", refuse)
    got, want = registry.queries()["check3_amount"](spark, str(DATA)).toPandas(), duck.execute(registry.oracle_sql()["check3_amount"]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_fields_are_sought_once(spark):
    """Each pattern stands in the plan of the receipts once, and only names that have letters' case are lower-cased."""
    plan = registry.receipt_fields(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    receipt = [p for name, patterns in extraction.PATTERNS.items() if name.startswith("receipt.") for p in patterns]
    assert [plan.count(f"){p}, 1)") for p in receipt] == [1] * len(receipt)
    assert "lower(" not in plan and "Window" not in plan


def test_types_of_words_with_case(spark, monkeypatch):
    monkeypatch.setattr(matching, "CONFIG", dataclasses.replace(matching.CONFIG, type_keywords=(("contract", ("po-", "合同")), ("receipt", ("签收",)))))
    df = spark.createDataFrame([("PO-1 签收.PDF",), ("Po-2",), ("签收.PDF",), ("合同",), ("İPO",)], "n string")
    assert [r[0] for r in df.select(matching.document_type(F.col("n"))).collect()] == ["contract", "contract", "receipt", "contract", "unknown"]


def test_matching_reads_keys_only(spark, duck, monkeypatch):
    def refuse(*a):
        raise AssertionError("rows of the sheet are not needed")

    monkeypatch.setattr(registry.demo, "sales_rows", refuse)
    for name in ("match_direct", "match_suffix"):
        got, want = registry.queries()[name](spark, str(DATA)).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
        assert _rows(got) == _rows(want)


def test_numbers_alone_are_those_of_the_groups(spark):
    names = "row_idx long, delivery_no string, customer string, material_name string, spec_model string, unit_price string, revenue_tax string, revenue_notax string, delivery_date string, confirm_date string"
    rows = spark.createDataFrame([(i, n, *["1"] * 8) for i, n in enumerate(["A", "A", "A ", None, " ", "nan", " nan", "B"])], names)
    assert _rows(grouping.delivery_numbers(rows).toPandas()) == _rows(grouping.delivery_groups(rows).select("delivery_no").toPandas())
