"""The five checks of a delivery group against its documents, as column expressions over prepared columns.

Every check yields an array of findings ``(code, system_value, document_value, text)``; an empty one passes. The
message is only a rendering. Texts have to be cleaned when they are ingested, so nothing here needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.dates import parse_date, parse_short_date
from ..functions.text import clean_composed, render_decimal, strip_pdf

PASS = "✓"
CHECKS = ("check1", "check2", "check3", "check4", "check5")
_MARKS = "①②③④⑤"


def _finding(test: Column, code: str, system, document, text: Column) -> Column:
    value = lambda x: F.coalesce((x if isinstance(x, Column) else F.lit(x)).cast("string"), F.lit(""))
    return F.when(test, F.struct(F.lit(code).alias("code"), value(system).alias("system_value"), value(document).alias("document_value"), text.alias("text")))


def _all(*findings: Column) -> Column:
    return F.array_compact(F.array(*findings))


def _only(code: str, text: str) -> Column:
    return F.array(F.struct(F.lit(code).alias("code"), F.lit("").alias("system_value"), F.lit("").alias("document_value"), F.lit(text).alias("text")))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _prepared(assigned: DataFrame) -> DataFrame:
    """``assigned`` with the cleaned texts and the days that the findings compare, each computed once (names begin with two underscores)."""
    texts = {
        "customer": "customer_name", "product": "material_name", "spec": "spec_model", "their_customer": "contract.customer_name", "their_product": "contract.product_name", "their_spec": "contract.spec_model",
        "number": "delivery_no", "their_number": "receipt.delivery_no", "date_text": "delivery_date", "their_date": "receipt.delivery_date", "signer": "receipt.signer", "person": "authorization.authorized_person",
    }
    out = assigned.withColumns({f"__{n}": clean_composed(F.col(c)) for n, c in texts.items()})
    return out.withColumns({"__day": parse_date(F.col("__date_text")), "__their_day": parse_date(F.col("__their_date")), "__confirm": parse_date(F.coalesce("confirm_date", F.lit(""))), "__sign": parse_short_date(F.coalesce("receipt.sign_date", F.lit("")), F.coalesce("confirm_date", F.lit("")))})


def contract_findings() -> Column:
    """Customer and product contain one another, the model is equal but for case, the price is equal. A side that is missing skips its comparison."""

    def apart(a: Column, b: Column) -> Column:
        return (a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a)

    customer, product, spec = (F.col(f"__{c}") for c in ("customer", "product", "spec"))
    their_customer, their_product, their_spec = (F.col(f"__their_{c}") for c in ("customer", "product", "spec"))
    return F.when(F.col("contract").isNull(), _only("contract_missing", "缺合同")).otherwise(
        _all(
            _finding(apart(customer, their_customer), "customer", customer, their_customer, _text("客户名称不一致：系统'", customer, "' vs 合同'", their_customer, "'")),
            _finding(apart(product, their_product), "product", product, their_product, _text("产品名称不一致：系统'", product, "' vs 合同'", their_product, "'")),
            _finding((spec != "") & (their_spec != "") & (F.lower(spec) != F.lower(their_spec)), "spec", spec, their_spec, _text("规格型号不一致：系统'", F.col("spec_model"), "' vs 合同'", F.col("contract.spec_model"), "'")),
            _finding(F.col("contract.unit_price") != F.col("unit_price"), "price", render_decimal(F.col("unit_price")), render_decimal(F.col("contract.unit_price")), _text("单价不一致：系统", render_decimal(F.col("unit_price")), " vs 合同", render_decimal(F.col("contract.unit_price")))),
        )
    )


def delivery_findings() -> Column:
    """Number, quantity and (if both can be read) date of the signed receipt."""
    number, theirs, date, their_date = F.col("__number"), F.col("__their_number"), F.col("__day"), F.col("__their_day")
    return F.when(F.col("receipt").isNull(), _only("receipt_missing", "缺回签联")).otherwise(
        _all(
            _finding((number != "") & (theirs != "") & (number != theirs), "delivery_no", number, theirs, _text("出库单号不一致：系统'", number, "' vs 回签联'", theirs, "'")),
            _finding(F.col("receipt.delivery_qty") != F.col("total_qty"), "quantity", F.col("total_qty"), F.col("receipt.delivery_qty"), _text("出库数量不一致：系统", F.col("total_qty").cast("string"), " vs 回签联", F.col("receipt.delivery_qty").cast("string"))),
            _finding(date != their_date, "delivery_date", date, their_date, _text("出库日期不一致：系统", F.col("__date_text"), " vs 回签联", F.col("receipt.delivery_date"))),
        )
    )


def amount_findings() -> Column:
    """Taxed revenue is price times quantity, untaxed revenue that over the tax rate, each within the tolerance. Multiplied out, so that no division rounds."""
    rate, tolerance = int(CONFIG.tax_rate * 100), F.lit(CONFIG.amount_tolerance)
    expected = (F.col("unit_price") * F.col("total_qty").cast("decimal(10,0)")).cast("decimal(24,4)")
    tax, notax = F.col("total_revenue_tax"), F.col("total_revenue_notax")
    gap = (F.lit(rate) * notax - F.lit(100) * expected).cast("decimal(30,4)")
    without_tax = F.bround((F.lit(100) * expected).cast("decimal(30,4)") / F.lit(rate), 2)
    return F.when(F.col("unit_price").isNull() | (F.col("total_qty") == 0), _only("incomplete", "数据不完整，无法计算")).otherwise(
        _all(
            _finding(F.abs(tax - expected) > tolerance, "revenue_tax", render_decimal(tax), render_decimal(expected), _text("含税收入差异：系统", render_decimal(tax), " vs 计算", render_decimal(expected), "，差", render_decimal(tax - expected))),
            _finding(F.abs(gap) > F.lit(rate) * tolerance, "revenue_notax", render_decimal(notax), without_tax, _text("不含税收入差异：系统", render_decimal(notax), " vs 计算", without_tax.cast("string"), "，差", F.bround(gap / F.lit(rate), 2).cast("string"))),
        )
    )


def timing_findings() -> Column:
    """Signed not after the revenue was confirmed, and in the same month."""
    confirm_text, sign_text = F.coalesce("confirm_date", F.lit("")), F.coalesce("receipt.sign_date", F.lit(""))
    confirm, sign = F.col("__confirm"), F.col("__sign")
    unread = lambda code, label, text: F.array(F.struct(F.lit(code).alias("code"), F.lit("").alias("system_value"), F.lit("").alias("document_value"), F.concat(F.lit(label), text).alias("text")))
    return (
        F.when(confirm_text == "", _only("confirm_missing", "收入确认日期缺失"))
        .when(sign_text == "", _only("sign_missing", "日期缺失"))
        .when(confirm.isNull(), unread("confirm_unreadable", "无法解析收入确认日期：", confirm_text))
        .when(sign.isNull(), unread("sign_unreadable", "无法解析签收日期：", sign_text))
        .otherwise(
            _all(
                _finding(sign > confirm, "signed_late", confirm, sign, _text("签收", sign.cast("string"), " > 确认", confirm.cast("string"), "，时点不合规")),
                _finding(F.trunc(sign, "month") != F.trunc(confirm, "month"), "other_month", confirm, sign, _text("签收", sign.cast("string"), " vs 确认", confirm.cast("string"), "，跨月")),
            )
        )
    )


def signer_findings() -> Column:
    """The signer is the person authorised."""
    signer, person = F.col("__signer"), F.col("__person")
    return (
        F.when(F.col("authorization").isNull(), _only("letter_missing", "✗ 未提供授权书"))
        .when(F.coalesce("receipt.signer", F.lit("")) == "", _only("signer_missing", "✗ 回签联未识别到签收人"))
        .when(person == "", _only("person_missing", "✗ 授权书未识别到被授权人"))
        .otherwise(_all(_finding(person != signer, "not_authorized", person, signer, _text('✗ 授权人"', person, '"≠签收人"', signer, '"'))))
    )


FINDINGS = {"check1": contract_findings, "check2": delivery_findings, "check3": amount_findings, "check4": timing_findings, "check5": signer_findings}


def message(findings: Column) -> Column:
    return F.when(F.size(findings) == 0, PASS).otherwise(F.array_join(F.transform(findings, lambda f: f["text"]), "; "))


def codes(findings: Column) -> Column:
    """The findings' codes joined by commas; empty if the check passes."""
    return F.array_join(F.transform(findings, lambda f: f["code"]), ",")


def attachment_index() -> Column:
    """The documents that are there, numbered in the fixed order of types."""
    there = F.array_compact(F.array(*[F.when(F.col(t).isNotNull(), F.concat(F.lit(label), strip_pdf(F.col(f"{t}.file_name")))) for t, label in CONFIG.type_labels]))
    return F.array_join(F.transform(there, lambda x, i: F.concat(F.lit("附件"), (i + 1).cast("string"), F.lit(":"), x)), "; ")


def attachment_result() -> Column:
    failed = F.concat_ws("、", *[F.when(F.size(f"{c}_findings") > 0, mark) for c, mark in zip(CHECKS, _MARKS, strict=True)])
    return F.when(failed == "", "全部通过").otherwise(F.concat(failed, F.lit("存在异常")))


def verify(assigned: DataFrame) -> DataFrame:
    """Groups with their documents (as :func:`..matching.assign_first` gives them) and the results of all checks."""
    receipt = {"logistics_company": "logistics_company", "logistics_no": "logistics_no", "customer_sign_date": "sign_date", "signer": "signer"}
    out = _prepared(assigned).withColumns({n: F.coalesce(f"receipt.{f}", F.lit("")) for n, f in receipt.items()} | {f"{c}_findings": f() for c, f in FINDINGS.items()})
    out = out.drop(*[c for c in out.columns if c.startswith("__")])
    out = out.withColumns({c: message(F.col(f"{c}_findings")) for c in CHECKS} | {f"{c}_codes": codes(F.col(f"{c}_findings")) for c in CHECKS})
    return out.withColumns({"attachment_index": attachment_index(), "attachment_result": attachment_result(), "all_pass": F.forall(F.array(*[F.col(c) for c in CHECKS]), lambda r: r == PASS)})
