"""Decoded files to verified groups, with a stub in place of the decoders."""

import io
from types import SimpleNamespace

from vouchlake.operators import checks, documents, grouping, matching
from vouchlake.sources import pdf, workbook


class _Page:
    def __init__(self, text="", spans=(), image=0.0, words=(), broken=False):
        self.text, self.spans, self.image, self.words, self.broken = text, spans, image, words, broken
        self.rect = SimpleNamespace(width=100.0, height=100.0)

    def get_text(self, kind):
        if self.broken:
            raise RuntimeError("torn")
        if kind == "text":
            return self.text
        lines = [{"spans": [{"text": t, "bbox": (x, y, x + 5.0, y + 2.0)}]} for t, x, y in self.spans]
        return {"blocks": [{"type": 0, "bbox": (0.0, 1.0, 50.0, 20.0), "lines": lines}, {"type": 1}]}

    def get_images(self, full):
        return [(7,)] if self.image else []

    def get_image_rects(self, _):
        return [SimpleNamespace(width=100.0, height=100.0 * self.image)]

    def get_pixmap(self, matrix):
        return SimpleNamespace(tobytes=lambda _: b"png" + str(id(self)).encode())


class _Doc(list):
    closed = False

    def close(self):
        self.closed = True


class _Ruled:
    def __init__(self, tables):
        self.tables, self.asked = tables, []

    def extract_tables(self, settings):
        self.asked.append(settings["vertical_strategy"])
        if settings["vertical_strategy"] == "lines":
            raise RuntimeError("no lines")
        return self.tables


def _stubs(monkeypatch, files, ruled, words):
    """``files``: content to pages; ``ruled``: content to pages of tables (an error, if missing); ``words``: what OCR reads."""
    drawn = []
    docs = {k: _Doc(v) for k, v in files.items()}

    def opened(stream, filetype):
        if stream not in docs:
            raise ValueError("not a document")
        return docs[stream]

    def data(image, lang, config, output_type):
        drawn.append(config)
        if words is None:
            raise RuntimeError("no words")
        return {"text": [w for w, _ in words], "conf": [c for _, c in words]}

    class Book(list):
        def __init__(self, stream):
            self.pages = ruled[stream.read()]

        def close(self):
            pass

    array = __import__("numpy").zeros((2, 2), "uint8")
    monkeypatch.setattr(pdf, "fitz", SimpleNamespace(open=opened, Matrix=lambda a, b: (a, b)))
    monkeypatch.setattr(pdf, "pdfplumber", SimpleNamespace(open=Book))
    monkeypatch.setattr(pdf, "pytesseract", SimpleNamespace(image_to_data=data, image_to_string=lambda *a, **k: "plain text", Output=SimpleNamespace(DICT=0)))
    monkeypatch.setattr(pdf, "Image", SimpleNamespace(open=lambda f: array, fromarray=lambda a: a), raising=False)
    return docs, drawn


def test_decoded_files_are_verified(spark, monkeypatch):
    contract = "甲方：测试公司\n产品名称：测试产品\n规格型号：A100\n" + "条款内容" * 20
    head, rows_ = ("含税单价", 10.0, 10.0), [("1", 10.0, 20.0)]
    letter = [("兹授权", 90.0), ("张三", 95.0), ("", -1.0), ("代表", 80.0)]
    files = {
        b"c": [_Page(contract)],
        b"r": [_Page("出库单号：ZB240101001\n合计：1件\n出库日期：2024-01-15\n签收日期：2024-01-18\n签收人：张三\n" + "备注说明" * 20), _Page(broken=True)],
        b"a": [_Page(image=1.0, spans=[head, ("数量", 60.0, 10.0), *rows_, ("2", 60.0, 20.0)])],
    }
    ruled = {b"c": [_Ruled([[["品名", "含税单价"], ["测试产品", "100"]]])], b"a": [_Ruled([])]}
    docs, drawn = _stubs(monkeypatch, files, ruled, letter)
    names = {b"c": "合同_ZB240101001.pdf", b"r": "回签联_ZB240101001.pdf", b"a": "授权书_ZB240101001.pdf", b"x": "合同_坏.pdf"}
    decoded = [r for content, name in names.items() for r in pdf.decode(name, content, True)]
    assert drawn == ["--oem 3 --psm 6"]  # only the scanned page, and its first mode is good enough
    assert all(d.closed for d in docs.values()) and ruled[b"c"][0].asked == ["lines", "text"] and ruled[b"a"][0].asked == []
    assert sum(r["kind"] == "warning" for r in decoded) == 2
    rows = spark.createDataFrame([[r.get(c) for c in pdf._COLUMNS] for r in decoded], pdf.SCHEMA)
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names.values())], "file_name string, doc_seq long")
    texts = {r.file_name: r for r in documents.documents(rows, order).collect()}
    assert texts["授权书_ZB240101001.pdf"].full_text == "兹授权 张三\n代表" and texts["授权书_ZB240101001.pdf"].page_types == ["scanned"]
    assert texts["回签联_ZB240101001.pdf"].page_types == ["native", "error"] and texts["回签联_ZB240101001.pdf"].warnings == ["Page 2: Processing error - torn"]
    assert texts["合同_坏.pdf"].full_text == "" and texts["合同_坏.pdf"].warnings == ["Failed to open PDF: not a document"]
    cells = {(r.file_name[:2], r.header, r.value) for r in documents.table_cells(rows, documents.page_texts(rows)).collect()}
    assert cells == {("合同", "品名", "测试产品"), ("合同", "含税单价", "100"), ("授权", "含税单价", "1"), ("授权", "数量", "2")}
    sheet = [(0, "ZB240101001", "测试公司", "测试产品", "A100", "100", "100", "88.5", "2024-01-15", "2024-01-20")]
    groups = grouping.delivery_groups(spark.createDataFrame(sheet, "row_idx long, delivery_no string, customer string, material_name string, spec_model string, unit_price string, revenue_tax string, revenue_notax string, delivery_date string, confirm_date string"))
    bridge = matching.match_documents(order.select("file_name"), groups.select("delivery_no"))
    out = checks.verify(matching.assign_first(groups, bridge, documents.classified(rows, order).drop("full_text", "page_types", "warnings"))).first()
    assert [out[c] for c in checks.CHECKS] == ["✓"] * 5 and out.attachment_result == "全部通过"


def test_ocr_falls_back_to_plain_text(monkeypatch):
    _stubs(monkeypatch, {b"a": [_Page(image=1.0)]}, {}, None)
    rows = [r for r in pdf.decode("a.pdf", b"a", True) if r["kind"] == "word"]
    assert [(r["text"], r["conf"], r["mode_no"]) for r in rows] == [("plain text", 50.0, 0)]
    assert not [r for r in pdf.decode("a.pdf", b"a", False) if r["kind"] == "word"]


def _book(sheet_rows: str, styles: str = "", book: str = "") -> bytes:
    import zipfile

    plain = workbook.write_workbook([["x"]])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            text = a.read(n).decode()
            if n.endswith("sheet1.xml"):
                text = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet_rows}</sheetData></worksheet>'
            b.writestr(n, text.replace("<sheets>", f"{book}<sheets>"))
        if styles:
            b.writestr("xl/styles.xml", f'<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{styles}</styleSheet>')
    return out.getvalue()


def test_date_cells_and_cells_without_references(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;年&quot;m&quot;月&quot;"/><numFmt numFmtId="165" formatCode="0.00&quot; day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    rows = '<row><c><v>1</v></c></row><row><c t="inlineStr"><is><t>day</t></is></c><c t="inlineStr"><is><t>n</t></is></c></row><row><c s="1"><v>45306</v></c><c s="3"><v>45306.5</v></c><c s="2"><v>45306.25</v></c></row><row r="6"><c r="B6" s="1"><v>x</v></c><c s="1"><v>1</v></c></row>'
    path = tmp_path / "d.xlsx"
    path.write_bytes(_book(rows, styles))
    got = workbook.read_workbook(spark, str(path)).orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [(0, "2024-01-15", "45306.5", "2024-01-15"), (3, None, "x", "1900-01-01")] and got[0].__fields__ == ["row_idx", "day", "n", "C"]
    spark.dataSource.register(workbook.WorkbookSource)
    assert [tuple(r) for r in spark.read.format("workbook").load(str(path)).orderBy("row_idx").collect()] == [tuple(r) for r in got]
    early = workbook.read_rows(__import__("zipfile").ZipFile(io.BytesIO(_book(rows, styles, '<workbookPr date1904="1"/>'))), "xl/worksheets/sheet1.xml")
    assert dict(early)[3][1] == "2028-01-16"
    filled = dict(workbook.read_rows(__import__("zipfile").ZipFile(io.BytesIO(workbook.fill_workbook(_book(rows, styles), {(3, "B"): "new", (4, "A"): "own"}))), "xl/worksheets/sheet1.xml"))
    assert filled[3][2] == "new" and filled[3][1] == "2024-01-15" and filled[4] == {1: "own"} and filled[6][2] == "x"


def test_headers_are_looked_up_and_white_space_is_no_key(spark):
    heads = [f"h{i}" for i in range(20)]
    heads[3], heads[8], heads[13] = "出库单号", "other", "金额"
    names = grouping.resolve_columns(heads)
    assert names["delivery_no"] == "出库单号" and names["revenue_tax"] == "金额" and names["confirm_date"] == "h14"
    schema = "row_idx long, delivery_no string, customer string, material_name string, spec_model string, unit_price string, revenue_tax string, revenue_notax string, delivery_date string, confirm_date string"
    rows = [(0, "K1　", "　c\t", *["1"] * 7), (1, "\t", *["1"] * 8), (2, "　", *["1"] * 8), (3, "nan ", *["1"] * 8)]
    got = grouping.delivery_groups(spark.createDataFrame(rows, schema)).collect()
    assert [(r.delivery_no, r.customer_name) for r in got] == [("K1", "c")]


def test_keys_of_many_lengths_match(spark):
    keys = ["Z" * n + "x" for n in range(1, 60)] + ["0123456789abcdefGHIJ"]
    files = spark.createDataFrame([("合同 " + "z" * 40 + "X.pdf",), ("zzz0123456789abcdefghij_.pdf",)], "file_name string")
    groups = spark.createDataFrame([(k,) for k in keys], "delivery_no string")
    for got in (matching.match_direct(files, groups), matching.match_documents(files, groups)):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, matching.match_direct_theta(files, groups).collect()))
