"""Grouping, matching, extraction, layout, sources and sinks."""

import io
import random
import time
import zipfile

from pyspark.sql import functions as F

from vouchlake.operators import extraction, grouping, layout, matching, report
from vouchlake.operators.images import clean_image, line_angles, skew_angle
from vouchlake.sources import files, pdf, sinks, workbook


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_groups(spark):
    names = "row_idx long, delivery_no string, customer string, material_name string, spec_model string, unit_price string, revenue_tax string, revenue_notax string, delivery_date string, confirm_date string"
    rows = [(0, "A", "c", "m", "s", "¥10", "1,000.5", "x", "d", None), (1, "A", "other", "m", "s", "20", "(0.5)", "2", "d", "e"), (2, "A ", "c", "m", "s", None, None, "", "d", "e"), (3, None, *["c"] * 8), (4, " ", *["c"] * 8), (5, "nan", *["c"] * 8)]
    got = {(r.delivery_no, r.first_row): r for r in grouping.delivery_groups(spark.createDataFrame(rows, names)).collect()}
    assert set(got) == {("A", 0), ("A", 2)}
    a = got["A", 0]
    assert (a.customer_name, str(a.unit_price), a.total_qty, str(a.total_revenue_tax), str(a.total_revenue_notax), a.row_indices, a.confirm_date) == ("c", "10.0000", 2, "1000.0000", "2.0000", [0, 1], "")
    assert got["A", 2].unit_price is None and got["A", 2].total_revenue_tax == 0


def test_columns_by_position_and_by_hint(spark):
    heads = [f"c{i}" for i in range(17)]
    heads[9], heads[14] = "出库日期", "收入确认日期"
    assert grouping.resolve_columns(heads)["confirm_date"] == "收入确认日期"
    assert grouping.resolve_columns(heads, by_hint=True)["confirm_date"] == "出库日期"
    assert "delivery_no" not in grouping.resolve_columns(heads[:8])


def test_matching_equals_containment(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choice("ZB01 ") for _ in range(rng.randrange(0, 5))) for _ in range(60)]
    names = ["".join(rng.choice("zb01 _") for _ in range(rng.randrange(3, 14))) for _ in range(80)]
    g, f = spark.createDataFrame([(k,) for k in keys], "delivery_no string"), spark.createDataFrame([(n,) for n in names], "file_name string")
    assert _rows(matching.match_direct(f, g)) == _rows(matching.match_direct_theta(f, g))


def test_suffix_only_without_a_direct_match(spark):
    g = spark.createDataFrame([("ZB1",), ("ZB10",), ("ZB24000123",), ("12345",)], "delivery_no string")
    f = spark.createDataFrame([("合同 zb10.pdf",), ("x_000123.pdf",), ("y12345z.pdf",), ("q 12 345.pdf",), ("none.pdf",)], "file_name string")
    bridge = matching.match_documents(f, g)
    assert _rows(bridge.select("file_name", "delivery_no")) == sorted([("合同 zb10.pdf", "ZB1"), ("合同 zb10.pdf", "ZB10"), ("x_000123.pdf", "ZB24000123"), ("y12345z.pdf", "12345"), ("q 12 345.pdf", "12345")], key=repr)
    assert _rows(matching.match_documents(f.where("file_name like '%zb10%'"), g, longest_only=True).select("delivery_no")) == [("ZB10",)]


def test_first_document_of_each_type(spark):
    docs = spark.createDataFrame([("a.pdf", "contract", 2), ("b.pdf", "contract", 1), ("c.pdf", "unknown", 0), ("d.pdf", "receipt", 5)], "file_name string, doc_type string, doc_seq long")
    bridge = spark.createDataFrame([("a.pdf", "K"), ("b.pdf", "K"), ("b.pdf", "K"), ("c.pdf", "K"), ("d.pdf", "L")], "file_name string, delivery_no string")
    out = {r.delivery_no: r for r in matching.assign_first(spark.createDataFrame([("K",), ("L",), ("M",)], "delivery_no string"), bridge, docs).collect()}
    assert out["K"].contract.file_name == "b.pdf" and out["K"].receipt is None and out["L"].receipt.doc_seq == 5 and out["M"].contract is None


def _choices(assigned):
    return _rows(assigned.select("delivery_no", *[F.col(f"{t}.doc_seq").alias(t) for t in matching.TYPES]))


def test_documents_are_assigned_as_over_the_bridge(spark):
    rng = random.Random(2)
    keys = ["".join(rng.choice("ZB01 ") for _ in range(rng.randrange(0, 8))) for _ in range(80)] + ["ZB1000123", "ZB2000123", "q" * 20, "𠀀b1", "zb1000123"]
    names = ["".join(rng.choice("zb01 _") for _ in range(rng.randrange(3, 16))) for _ in range(120)] + ["x000123", "x_ZB2000123", "y" + "q" * 20, "?b1", "𠀀b1.pdf"]
    g = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "delivery_no string, n long")
    docs = spark.createDataFrame([(n, rng.choice((*matching.TYPES, "unknown")), i) for i, n in enumerate(names)], "file_name string, doc_type string, doc_seq long")
    assert _choices(matching.assign_documents(g, docs)) == _choices(matching.assign_first(g, matching.match_documents(docs.select("file_name"), g), docs))
    assert _choices(matching.assign_documents(g.where("n < 0"), docs)) == [] and len(_choices(matching.assign_documents(g, docs.limit(0)))) == len(keys)


def test_common_suffixes_do_not_multiply(spark):
    """30,000 numbers and 3,000 files with the same last six characters: 90 million pairs, which no assignment needs."""
    g = spark.range(30_000).select(F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("777777")).alias("delivery_no"))
    docs = spark.range(3_000).select(F.concat(F.lit("合同_777777_"), F.col("id").cast("string")).alias("file_name"), F.lit("contract").alias("doc_type"), (F.col("id") + 5).alias("doc_seq"))
    began = time.time()
    assert [tuple(r) for r in matching.assign_documents(g, docs).groupBy("contract.doc_seq").count().collect()] == [(5, 30_000)]
    assert time.time() - began < 40


def test_only_pieces_that_look_like_a_number_meet_numbers(spark):
    g = spark.createDataFrame([("ZB000000001",), ("ZB123456789",)], "delivery_no string")
    patterns, whole = matching._places(g.select(F.col("delivery_no").alias("anchor")))
    pieces = spark.createDataFrame([("回签联_ZB123456782.PDF",)], "n string").select(F.regexp_extract_all("n", F.lit(patterns[0]), F.lit(1)).alias("p")).first().p
    assert whole and pieces == []  # no number ends in 2
    assert matching.match_direct(spark.createDataFrame([("回签联_ZB123456789.PDF",)], "file_name string"), g).count() == 1


def test_types(spark):
    names = ["合同.pdf", "销售出库单.pdf", "送货单1.PDF", "授权.pdf", "对账单.pdf", "x.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(matching.document_type(F.col("n"))).collect()] == ["contract", "contract", "receipt", "authorization", "reconciliation", "unknown"]


def test_extraction(spark):
    docs = [
        ("合同1.pdf", 1, "甲方：测试公司，地址\n产品名称：传感器\n规格型号：A-100\n含税单价：1,234.50元\n"),
        ("回签联1.pdf", 2, "出库单号：ZB2401\n合计：1,200.5件\n出库日期：2024年1月5日\n物流公司：顺丰\n物流单号：SF12345678\n签收日期：1/8\n签收人：张三\n客户名称：甲公司\n"),
        ("授权书1.pdf", 3, "兹授权 李四 为我司签收人"),
        ("对账单.pdf", 4, "甲方：不读"),
        ("回签联2.pdf", 5, "签收 2024/01/15 签收人：某某公司"),
        ("合同2.pdf", 6, ""),
    ]
    cells = spark.createDataFrame([("合同2.pdf", 0, 0, r, "单价", v) for r, v in enumerate(["-", "0.01", "88.5", "99"])] + [("回签联2.pdf", 0, c, r, h, v) for c, h, vs in ((0, "数量", ["1", "2.9", "x", ""]), (1, "QTY", ["5", "1.2.3"]), (2, "qty", ["1,000"])) for r, v in enumerate(vs)], "file_name string, table_idx int, col_idx int, row_idx int, header string, value string")
    out = {r.file_name: r for r in extraction.classify_documents(spark.createDataFrame(docs, "file_name string, doc_seq long, full_text string"), cells).collect()}
    c = out["合同1.pdf"]
    assert (c.customer_name, c.product_name, c.spec_model, str(c.unit_price)) == ("测试公司", "传感器", "A-100", "1234.5000")
    r = out["回签联1.pdf"]
    assert (r.delivery_no, r.delivery_qty, r.delivery_date, r.logistics_company, r.logistics_no, r.sign_date, r.signer, r.customer_name) == ("ZB2401", 1200, "2024年1月5日", "顺丰", "SF12345678", "1/8", "张三", "甲公司")
    assert out["授权书1.pdf"].authorized_person == "李四" and out["对账单.pdf"].customer_name == ""
    assert out["回签联2.pdf"].sign_date == "24/01" and out["回签联2.pdf"].signer == "" and out["回签联2.pdf"].delivery_qty == 1000
    assert str(out["合同2.pdf"].unit_price) == "88.5000"


def test_pages_and_blocks(spark):
    cases = [("", 0.0, "scanned"), ("x" * 9, 0.29, "scanned"), ("x" * 10, 0.29, "native"), ("x" * 49, 0.3, "scanned"), ("x" * 50, 0.29, "native"), ("x" * 50, 0.3, "mixed"), ("字" * 30, 0.0, "native"), ("字" * 29, 0.5, "scanned"), ("字" * 5, 0.0, "native"), (None, 0.0, "scanned")]
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(cases)], "i int, t string, r double")
    assert [x[1] for x in df.select("i", layout.page_type(F.col("t"), F.col("r"))).orderBy("i").collect()] == [c[2] for c in cases]
    df = spark.createDataFrame([(10.0, 100.0), (4.9, 100.0), (96.0, 100.0), (1.0, 0.0)], "y double, h double")
    assert [x[0] for x in df.select(layout.block_type(F.col("y"), F.col("h"))).collect()] == ["paragraph", "header", "footer", "paragraph"]


def test_tables_from_positions(spark):
    spans = [("p", i, t, x, y) for i, (t, x, y) in enumerate([("品名", 0.0, 1.0), ("数量", 100.0, 5.5), ("A", 2.0, 9.0), ("B", 6.0, 9.5), ("7", 99.0, 9.0), ("far", 400.0, 9.0), (" ", 0.0, 30.0)])]
    df = spark.createDataFrame(spans, "page string, seq int, text string, x0 double, y0 double")
    rows = {r.seq: r.row_no for r in layout.cluster_rows(df, ["page"]).collect()}
    assert rows == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2}
    grid = {r.row_no: list(r.cells) for r in layout.positional_tables(df, ["page"]).collect()}
    assert grid == {0: ["品名", "数量", ""], 1: ["A B", "7", "far"]}
    cells = layout.grid_cells(layout.positional_tables(df, ["page"]), ["page"])
    assert {(r.header, r.value) for r in cells.collect()} == {("品名", "A B"), ("数量", "7"), ("Column", "far")}
    assert layout.table_confidence(cells, ["page"]).first().confidence == 1.0
    few = df.where("seq < 3")
    assert layout.positional_tables(few, ["page"]).count() == 0


def test_headers_and_columns(spark):
    one = spark.range(1)
    got = one.select(layout.unique_headers(F.array(*[F.lit(h) for h in ("a", "", "a", None, "a")])).alias("h"), layout.detect_columns(F.array(*[F.lit(float(x)) for x in (37.5, 0, 8, 22, 60)])).alias("c"), layout.fit_row(F.array(F.lit(" x "), F.lit(None).cast("string")), F.lit(3)).alias("r"), layout.nearest_column(F.lit(50.0), F.array(F.lit(0.0), F.lit(100.0))).alias("n"), layout.nearest_column(F.lit(49.0), F.array(F.lit(0.0), F.lit(98.0))).alias("t")).first()
    assert got.h == ["a", "Column", "a_1", "Column_1", "a_2"] and got.c == [0.0, 30.0, 60.0] and got.r == ["x", "", ""] and got.n is None and got.t == 0


def test_headers_of_a_very_wide_table(spark):
    n, began = 100_000, time.time()
    heads = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("h"), (i % 3).cast("string"))))
    got = spark.range(1).select(layout.unique_headers(heads).alias("h")).first().h
    seen: dict[str, int] = {}
    for i, h in enumerate(got, 1):
        name = "Column" if i % 4 == 0 else f"h{i % 3}"
        assert h == (f"{name}_{seen[name]}" if name in seen else name)
        seen[name] = seen.get(name, 0) + 1
    assert len(got) == n and time.time() - began < 60  # comparing each with all before it takes minutes
    assert spark.range(1).select(layout.unique_headers(F.array().cast("array<string>")).alias("h")).first().h == []


def test_ocr(spark):
    words = [("p", i, t, c) for i, (t, c) in enumerate([("a", 90.0), ("b", 0.0), ("c", 70.0), ("", -1.0), ("", -1.0), ("d", 40.0)])]
    df = spark.createDataFrame(words, "page string, seq int, text string, conf double")
    assert [(r.block_no, r.content, r.confidence) for r in layout.ocr_blocks(df, ["page"]).orderBy("block_no").collect()] == [(0, "a c", 0.8), (1, "d", 0.4)]
    assert [(r.text, round(r.confidence, 4)) for r in layout.ocr_pages(df, ["page"]).collect()] == [("a c\nd", 0.6667)]
    modes = spark.createDataFrame([("p", 0, 0.4), ("p", 1, 0.4), ("p", 2, 0.3), ("q", 0, 0.2), ("q", 1, 0.5), ("q", 2, 0.9)], "page string, mode_no int, confidence double")
    assert _rows(layout.best_mode(modes, ["page"])) == [("p", 0, 0.4), ("q", 1, 0.5)]


def test_images():
    import numpy as np

    assert skew_angle(np.array([1.0, 2.0, 3.0, 80.0])) == 2.0 and skew_angle(np.array([0.1, 0.2])) == 0.0 and skew_angle(np.array([])) == 0.0
    assert line_angles(np.array([[0.0, 0.0, 1.0, 1.0]]))[0] == 45.0
    assert clean_image(np.zeros((4, 4), np.uint8)).shape == (4, 4)


def test_files(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "sub/d.Pdf", "x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 1536)
    found = files.scan_pdfs(spark, f' "{tmp_path}" ')
    assert [(r.file_name, r.folder, r.size_label) for r in files.list_files(found, str(tmp_path)).orderBy("doc_seq").collect()] == [("a.pdf", ".", "1.5 KB"), ("b.PDF", ".", "1.5 KB"), ("d.Pdf", "sub", "1.5 KB")]
    rows = pdf.process_pdfs(found).collect()
    assert {r.file_name for r in rows} == {"a.pdf", "b.PDF", "d.Pdf"} and all(r.kind == "warning" for r in rows)


def test_workbook_round_trip(spark, tmp_path):
    heads = [f"h{i}" for i in range(17)]
    heads[8] = "出库单号"
    data = [["title"], heads, *[[*[f"v{r}{c}" for c in range(8)], key, *["1"] * 8] for r, key in enumerate(["K1", "K1", None])]]
    book = workbook.write_workbook(data, "样本")
    path = tmp_path / "s.xlsx"
    path.write_bytes(book)
    spark.dataSource.register(workbook.WorkbookSource)
    sheet = spark.read.format("workbook").option("sheet", "样本").load(str(path))
    rows = sheet.orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == [0, 1, 2] and rows[1]["出库单号"] == "K1" and rows[2]["出库单号"] is None and rows[0].h0 == "v00"
    groups = grouping.delivery_groups(grouping.read_sample(sheet))
    assert groups.first().row_indices == [0, 1]
    results = groups.select(F.explode("row_indices").alias("row_idx"), *[F.lit(f"<{n}>").alias(n) for n in report.OUTPUTS])
    filled = zipfile.ZipFile(io.BytesIO(sinks.fill_sheet(book, results, "样本")))
    cells = dict(workbook.read_rows(filled, "xl/worksheets/sheet1.xml"))
    assert cells[3][18] == "<logistics_company>" and 20 not in cells[3] and cells[4][29] == "<attachment_result>" and 18 not in cells[5] and cells[3][1] == "v00"


def test_summary_csv_has_a_byte_order_mark(spark, tmp_path):
    sinks.write_summary_csv(spark.createDataFrame([("ZB1", 2)], "`出库单号` string, n int").coalesce(1), str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part-*")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbf") and "出库单号,n\nZB1,2" in text.decode("utf-8-sig")


def test_stream_reads_each_file_once(spark, tmp_path):
    from vouchlake.streaming.ingest import stream_documents

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"x")
    out = []
    for name in ("b.pdf", None):
        q = stream_documents(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: out.extend(r.file_name for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        if name:
            (tmp_path / "in" / name).write_bytes(b"y")
    assert sorted(out) == ["a.pdf", "b.pdf"]
