"""The five checks, attachments and summaries."""

from decimal import Decimal

import pytest

from vouchlake.operators import checks, report

GROUP = {
    "delivery_no": "ZB240101001", "row_indices": [0], "customer_name": "测试公司", "material_name": "测试产品", "spec_model": "A100", "unit_price": Decimal("100"), "total_qty": 10,
    "total_revenue_tax": Decimal("1000"), "total_revenue_notax": Decimal("884.96"), "delivery_date": "2024-01-15", "confirm_date": "2024-01-20",
}
DOC = {"file_name": "test.pdf", "doc_type": "", "doc_seq": 1, "customer_name": "", "product_name": "", "spec_model": "", "unit_price": None, "delivery_no": "", "delivery_qty": None, "delivery_date": "", "logistics_company": "", "logistics_no": "", "sign_date": "", "signer": "", "authorized_person": ""}
_D = "struct<file_name:string,doc_type:string,doc_seq:bigint,customer_name:string,product_name:string,spec_model:string,unit_price:decimal(20,4),delivery_no:string,delivery_qty:int,delivery_date:string,logistics_company:string,logistics_no:string,sign_date:string,signer:string,authorized_person:string>"
SCHEMA = (
    "delivery_no string, row_indices array<bigint>, customer_name string, material_name string, spec_model string, unit_price decimal(20,4), total_qty bigint, total_revenue_tax decimal(20,4), total_revenue_notax decimal(20,4), "
    f"delivery_date string, confirm_date string, contract {_D}, receipt {_D}, reconciliation {_D}, authorization {_D}"
)


def _verify(spark, *cases):
    rows = []
    for group, docs in cases:
        values = {**GROUP, **group}
        rows.append(tuple(values.values()) + tuple(tuple({**DOC, **docs[t], "doc_type": t}.values()) if t in docs else None for t in ("contract", "receipt", "reconciliation", "authorization")))
    return checks.verify(spark.createDataFrame(rows, SCHEMA))


CONTRACT = {"customer_name": "测试公司", "product_name": "测试产品", "spec_model": "a100", "unit_price": Decimal("100")}
RECEIPT = {"delivery_no": "ZB240101001", "delivery_qty": 10, "delivery_date": "2024/01/15", "sign_date": "2024-01-18", "signer": "张三"}
LETTER = {"authorized_person": "张三"}
CASES = [
    ("check1", {}, {"contract": CONTRACT}, "✓"),
    ("check1", {}, {}, "缺合同"),
    ("check1", {}, {"contract": {**CONTRACT, "unit_price": Decimal("90")}}, "单价不一致：系统100 vs 合同90"),
    ("check1", {"customer_name": ""}, {"contract": CONTRACT}, "✓"),
    ("check1", {}, {"contract": {**CONTRACT, "customer_name": "测试公司北京"}}, "✓"),
    ("check1", {}, {"contract": {**CONTRACT, "customer_name": "别的"}}, "客户名称不一致：系统'测试公司' vs 合同'别的'"),
    ("check2", {}, {"receipt": RECEIPT}, "✓"),
    ("check2", {}, {}, "缺回签联"),
    ("check2", {}, {"receipt": {**RECEIPT, "delivery_qty": 9}}, "出库数量不一致：系统10 vs 回签联9"),
    ("check2", {}, {"receipt": {**RECEIPT, "delivery_date": "1月15日"}}, "✓"),
    ("check3", {}, {}, "✓"),
    ("check3", {"total_revenue_tax": Decimal("1050")}, {}, "含税收入差异：系统1050 vs 计算1000，差50"),
    ("check3", {"unit_price": None}, {}, "数据不完整，无法计算"),
    ("check3", {"total_revenue_tax": Decimal("1001"), "total_revenue_notax": Decimal("883.95")}, {}, "不含税收入差异：系统883.95 vs 计算884.96，差-1.01"),
    ("check4", {}, {"receipt": RECEIPT}, "✓"),
    ("check4", {"confirm_date": "2024-02-03"}, {"receipt": {**RECEIPT, "sign_date": "2024-01-28"}}, "签收2024-01-28 vs 确认2024-02-03，跨月"),
    ("check4", {"confirm_date": ""}, {"receipt": RECEIPT}, "收入确认日期缺失"),
    ("check4", {}, {}, "日期缺失"),
    ("check4", {"confirm_date": "x"}, {"receipt": RECEIPT}, "无法解析收入确认日期：x"),
    ("check4", {}, {"receipt": {**RECEIPT, "sign_date": "1/25"}}, "签收2024-01-25 > 确认2024-01-20，时点不合规"),
    ("check5", {}, {"receipt": RECEIPT, "authorization": LETTER}, "✓"),
    ("check5", {}, {"receipt": RECEIPT}, "✗ 未提供授权书"),
    ("check5", {}, {"authorization": LETTER}, "✗ 回签联未识别到签收人"),
    ("check5", {}, {"receipt": RECEIPT, "authorization": {}}, "✗ 授权书未识别到被授权人"),
    ("check5", {}, {"receipt": {**RECEIPT, "signer": "李四"}, "authorization": LETTER}, '✗ 授权人"张三"≠签收人"李四"'),
]


@pytest.fixture(scope="module")
def results(spark):
    return [r for r in _verify(spark, *[({**g, "delivery_no": g.get("delivery_no", "ZB240101001"), "row_indices": [i]}, d) for i, (_, g, d, _) in enumerate(CASES)]).collect()]


def test_checks(results):
    by = {r.row_indices[0]: r for r in results}
    assert [by[i][c] for i, (c, *_) in enumerate(CASES)] == [m for *_, m in CASES]


def test_attachments_and_summary(spark):
    every = {"contract": {**CONTRACT, "file_name": "合同1.pdf"}, "receipt": {**RECEIPT, "file_name": "签收.PDF"}, "authorization": {**LETTER, "file_name": "授权.pdf"}}
    out = _verify(spark, ({}, every), ({"total_revenue_tax": Decimal("1050")}, {}))
    rows = {r.all_pass: r for r in out.collect()}
    assert rows[True].attachment_index == "附件1:合同合同1; 附件2:回签联签收; 附件3:授权书授权" and rows[True].attachment_result == "全部通过"
    assert rows[False].attachment_index == "" and rows[False].attachment_result == "①、②、③、④、⑤存在异常"
    s = report.summarize(out)
    assert s.first().all_pass == 1 and s.first().check3_fail == 1
    assert report.pass_rate(s).first().pass_rate_text == "50%"
    assert report.pass_rate(report.summarize(out.limit(0))).first().pass_rate == 0
    assert {(r.check_name, r.passed, r.failed) for r in report.per_check(s).collect()} == {(f"check{i}", 1, 1) for i in range(1, 6)}
    assert [r["总结"] for r in report.result_summary(out).orderBy("含税收入").collect()] == ["全部通过", "存在异常"]


def test_checks_run_without_python(spark):
    plan = _verify(spark, ({}, {}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_multiplied_tolerance_equals_division():
    import random

    rng = random.Random(5)
    for _ in range(20_000):
        price, qty = Decimal(rng.randrange(1, 10**8)) / 10000, rng.randrange(1, 500)
        notax = (price * qty / Decimal("1.13")).quantize(Decimal("0.0001")) + Decimal(rng.randrange(-20_000, 20_000)) / 10000
        assert (abs(113 * notax - 100 * price * qty) > 113) == (abs(notax - price * qty / Decimal("1.13")) > 1)
