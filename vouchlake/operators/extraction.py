"""Fields of documents by patterns over their text, and by their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.amounts import parse_amount
from ..functions.text import clean_composed, let, normalize_fullwidth, strip
from .matching import document_type

# Labels in front of a field, and what the field may hold, in order of precedence.
_NUMBER = r"[\d,.，．]+"
_DAY = r"\d{4}[-/年.]\d{1,2}[-/月.]\d{1,2}日?"
PATTERNS: dict[str, tuple[str, ...]] = {
    "contract.customer_name": (
        r"(?:甲方|甲方名称|买方|购买方|客户|需方|采购方|发包方)[：:]\s*([^\n\r,，;；]{2,40})",
        r"(?:乙方|卖方|销售方|供方|供应商|承包方)[：:]\s*([^\n\r,，;；]{2,40})",
    ),
    "contract.product_name": (
        r"(?:产品名称|品名|货物名称|物料名称|商品名称|货物描述)[：:]\s*([^\n\r]{2,60})",
        r"(?:品名及规格|产品及规格)[：:]\s*([^\n\r]{2,60})",
    ),
    "contract.spec_model": (r"(?:规格型号|规格|型号|外形尺寸)[：:]\s*([^\n\r]{1,50})",),
    "contract.unit_price": (
        rf"(?:含税单价|含税价格|含税价|单价)[：:]\s*({_NUMBER})",
        rf"(?:不含税单价|不含税价格|不含税价)[：:]\s*({_NUMBER})",
        rf"(?:价格|售价)[：:]\s*({_NUMBER})",
        rf"(?:单价|含税单价)\s+({_NUMBER})",
    ),
    "receipt.delivery_no": (r"(?:出库单号|单据编号|单号|编号|No|NO)[.：:]*\s*(\S{4,25})",),
    "receipt.delivery_qty": (
        r"(?:合计|总数量|总计|数量合计)[：:]*\s*(\d+(?:[.,]\d+)?)\s*(?:件|个|台|套|kg|吨)?",
        r"(?:数量)\s+(\d+)",
    ),
    "receipt.delivery_date": (
        rf"(?:制单日期|出库日期|日期|发货日期)[：:]\s*({_DAY})",
        r"(?:制单日期|出库日期)[：:]\s*(\d{4}\d{2}\d{2})",
        r"(?:日期)[：:]\s*(\d{1,2}月\d{1,2}日)",
    ),
    "receipt.logistics_company": (r"(?:物流公司|快递公司|承运人|物流|运输公司)[：:]\s*([^\n，；:：]{2,20})",),
    "receipt.logistics_no": (
        r"(?:物流单号|快递单号|运单号|物流编号|快递编号)[：:]\s*([A-Za-z0-9]{6,25})",
        r"(?:物流单号|快递单号|运单号)[：:]\s*(\S{6,25})",
    ),
    "receipt.sign_date": (
        rf"(?:签收日期|收货日期|客户签收日期)[：:]\s*({_DAY})",
        r"(?:签收日期|收货日期)[：:]\s*(\d{1,2}[/月]\d{1,2}日?)",
        r"(?:签收|收货|签名).*?(\d{1,2}/\d{1,2})",
        r"(\d{1,2}月\d{1,2}日)\s*(?:签收|收到|确认)",
    ),
    "receipt.signer": (
        r"(?:签收人|收货人|领货人|签收)[：:]\s*([^\n，；(（【章]{2,8})",
        r"(?:收货方签章|客户签章|客户签名)[：:]*\s*([^\n，；(（【章]{2,8})",
    ),
    "receipt.customer_name": (r"(?:客户名称|客户|收货单位|购买方|收货方)[：:]\s*([^\n，；]{2,40})",),
    "authorization.authorized_person": (
        r"(?:被授权人|授权代表|受托人|被委托人)[：:]\s*([^\n，；和及]{2,8})",
        r"(?:兹授权|特授权|现授权|兹委托)\s*([^\n，；且和及]{2,5})\s*(?:为|作为|代为|代表)",
        r"(?:授权|委托)\s+([^\n，；且和及]{2,5})\s+(?:为|作为|代为|代表)",
    ),
}
PRICE_WORDS = ("单价", "价格", "含税")
QUANTITY_WORDS = ("数量", "qty")


def first_match(text: Column, patterns: tuple[str, ...], dot_all: bool = False) -> Column:
    """Group 1, cleaned, of the first pattern that matches; empty if none does. Text has to be in NFC. No group can match empty text, so each pattern is tried once."""
    flags = "(?Us)" if dot_all else "(?U)"
    # not nullif: inside a condition its value would be written out, and computed, twice
    found = [F.get(F.array_remove(F.array(F.regexp_extract(text, flags + p, 1)), ""), 0) for p in patterns]
    return clean_composed(F.coalesce(*found))


def _field(text: Column, name: str) -> Column:
    return first_match(text, PATTERNS[name], dot_all=name == "receipt.sign_date")


def _person(value: Column, *without: str) -> Column:
    def checked(v: Column) -> Column:
        fits = F.length(v).between(2, 8)
        for w in without:
            fits = fits & ~F.contains(v, F.lit(w))
        return F.when(fits, v).otherwise("")

    return let(value, checked)


def contract_fields(text: Column) -> dict[str, Column]:
    return {n: _field(text, f"contract.{n}") for n in ("customer_name", "product_name", "spec_model")} | {"unit_price": parse_amount(_field(text, "contract.unit_price"), 4).cast("decimal(20,4)")}


def receipt_fields(text: Column) -> dict[str, Column]:
    out = {n: _field(text, f"receipt.{n}") for n in ("delivery_no", "delivery_date", "logistics_company", "logistics_no", "sign_date", "customer_name")}
    qty = F.floor(F.replace(_field(text, "receipt.delivery_qty"), F.lit(",")).try_cast("double")).cast("int")
    return out | {"delivery_qty": qty, "signer": _person(_field(text, "receipt.signer"), "章", "公司")}


def authorization_fields(text: Column) -> dict[str, Column]:
    return {"authorized_person": _person(_field(text, "authorization.authorized_person"))}


FIELDS = ("customer_name", "product_name", "spec_model", "unit_price", "delivery_no", "delivery_qty", "delivery_date", "logistics_company", "logistics_no", "sign_date", "signer", "authorized_person")


def classify_documents(documents: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """``documents(file_name, doc_seq, full_text)`` with type, confidence and fields; what a type does not have is empty, or null for price and quantity.

    ``full_text`` has to be in NFC. Prices and quantities that the text lacks come from ``cells(file_name,
    table_idx, col_idx, row_idx, header, value)``, if given.
    """
    base = documents.withColumns({"doc_type": document_type(F.col("file_name")), "full_text": normalize_fullwidth(F.col("full_text")), "confidence": F.lit(CONFIG.extraction_confidence)})
    by_type = {"contract": contract_fields, "receipt": receipt_fields, "authorization": authorization_fields}
    found: dict[str, list] = {}
    for kind, fields in by_type.items():
        for name, value in fields(F.col("full_text")).items():
            found.setdefault(name, []).append((kind, value))
    columns = {}
    for name in FIELDS:
        out = None
        for kind, value in found[name]:
            test = F.col("doc_type") == kind
            out = F.when(test, value) if out is None else out.when(test, value)
        columns[name] = out if name in ("unit_price", "delivery_qty") else out.otherwise("")
    out = base.withColumns(columns)
    if cells is not None:
        tables = table_prices(cells).join(table_quantities(cells), "file_name", "full_outer")
        out = out.join(tables, "file_name", "left")
        out = out.withColumns({"unit_price": F.coalesce("unit_price", F.when(F.col("doc_type") == "contract", F.col("table_price"))), "delivery_qty": F.coalesce("delivery_qty", F.when(F.col("doc_type") == "receipt", F.col("table_qty")))}).drop("table_price", "table_qty")
    return out


def _header_has(words: tuple[str, ...], lower: bool = False) -> Column:
    header, out = F.lower("header") if lower else F.col("header"), F.lit(False)
    for w in words:
        out = out | F.contains(header, F.lit(w))
    return out


def table_prices(cells: DataFrame) -> DataFrame:
    """``(file_name, table_price)``: the first plausible amount (above 0.01, below 999999) under a price header, by table, column and row."""
    price = parse_amount(F.col("value"), 4).cast("decimal(20,4)")
    rows = cells.where(_header_has(PRICE_WORDS)).withColumn("p", price).where("p > 0.01 and p < 999999")
    return rows.groupBy("file_name").agg(F.min_by("p", F.struct("table_idx", "col_idx", "row_idx")).alias("table_price"))


def table_quantities(cells: DataFrame) -> DataFrame:
    """``(file_name, table_qty)``: the whole numbers under a quantity header, summed; of several such columns the last with a positive sum. A column with a malformed number does not count."""
    digits = strip(F.col("value")).rlike(r"^[\d.,]*\d[\d.,]*$")
    number = F.replace(strip(F.col("value")), F.lit(",")).try_cast("double")
    columns = cells.where(_header_has(QUANTITY_WORDS, lower=True) & digits).groupBy("file_name", "table_idx", "col_idx").agg(F.sum(F.floor(number)).alias("t"), F.bool_and(number.isNotNull()).alias("ok"))
    return columns.where("ok and t > 0").groupBy("file_name").agg(F.max_by(F.col("t").cast("int"), F.struct("table_idx", "col_idx")).alias("table_qty"))
