"""An audit sample derived from orders and line items: sheet rows, files and documents.

A delivery note is an order. What documents say departs from the sheet for some orders (by remainders of the order
key), so that every check passes and fails. The SQL twin of these rules is in :mod:`.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.checks import verify
from ..operators.extraction import classify_documents
from ..operators.grouping import delivery_groups, delivery_numbers
from ..operators.matching import assign_documents
from ..tables import read_table, stored

DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "yyyy年M月d日")
PEOPLE = ("张三", "李四", "王五", "赵六")
CONTRACT, RECEIPT, LETTER, LIST = 1, 2, 3, 4
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _in_layout(day: Column, pick: Column) -> Column:
    out = None
    for i, layout in enumerate(DATE_LAYOUTS):
        text = F.date_format(day, layout)
        out = F.when(pick % 5 == i, text) if out is None else out.when(pick % 5 == i, text)
    return out


def _number(k: Column) -> Column:
    return F.concat(F.lit("ZB"), F.lpad(k.cast("string"), 9, "0"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part, order and customer: ``k`` (order key), the texts, ``price``, ``ship`` and the columns that put an order's rows in sequence."""
    items, orders, customers, parts = (read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_orderkey").alias("k"), F.col("c_name").alias("customer"), F.col("p_name").alias("material_name"), F.col("p_type").alias("spec_model"),
        F.floor("p_retailprice").cast("decimal(20,4)").alias("price"), F.to_date("l_shipdate").alias("ship"), *_ORDER,
    )


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet: a row for each line item under logical names, with ``k`` (order key), ``price`` and ``ship`` of the order's first row."""
    order = Window.partitionBy("k").orderBy(*_ORDER)
    k = F.col("k")
    rows = _lines(spark, sf_dir).select(
        "k", (F.row_number().over(order) - 1).cast("long").alias("row_idx"), "customer", "material_name", "spec_model",
        _number(k).alias("delivery_no"), F.first("price").over(order).alias("price"), F.first("ship").over(order).alias("ship"),
    )
    price = F.col("price").cast("string")
    return rows.select(
        "k", "row_idx", "customer", "material_name", "spec_model", "delivery_no", "price", "ship",
        F.when(k % 4 == 0, price).when(k % 4 == 1, F.concat(F.lit("¥"), price)).when(k % 4 == 2, F.concat(F.lit("CNY "), price)).otherwise(F.concat(price, F.lit("元"))).alias("unit_price"),
        (F.col("price") + F.when(k % 6 == 0, F.lit("1.0100")).otherwise("0").cast("decimal(20,4)")).cast("decimal(20,4)").cast("string").alias("revenue_tax"),
        (F.col("price") * F.lit("0.885").cast("decimal(4,3)") + F.when(k % 8 == 0, 2).otherwise(0).cast("decimal(20,4)")).cast("decimal(20,4)").cast("string").alias("revenue_notax"),
        _in_layout(F.col("ship"), k).alias("delivery_date"), F.when(k % 17 != 0, _in_layout(F.date_add("ship", (k % 9).cast("int")), k + 1)).alias("confirm_date"),
    )


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet's rows, joined once for groups, documents and results."""
    return stored(sales_rows(spark, sf_dir))


def groups(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return delivery_groups(sales_rows(spark, sf_dir) if rows is None else rows)


def order_facts(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """``(k, customer, item, ship, n)``: what the documents say of an order, by its first row. Without ``rows`` the lines are aggregated as they come from their joins; facts that nobody reads leave the plan, with the columns behind them."""
    rows, order = (_lines(spark, sf_dir), F.struct(*_ORDER)) if rows is None else (rows, F.col("row_idx"))
    first = lambda c: F.min_by(c, order)
    return rows.groupBy("k").agg(first("customer").alias("customer"), first(F.struct("material_name", "spec_model", "price")).alias("item"), first("ship").alias("ship"), F.count("*").alias("n"))


def files(orders: DataFrame) -> DataFrame:
    """``orders(k, ...)`` with a row for each of an order's documents: ``kind``, ``doc_seq`` and ``file_name``, which come from the key alone."""
    k, dn = F.col("k"), _number(F.col("k"))
    short = F.when(k % 13 == 0, F.right(dn, F.lit(6))).otherwise(dn)
    kinds = ((k % 5 != 0, CONTRACT, "合同_", short, ".pdf"), (k % 7 != 0, RECEIPT, "回签联_", short, ".PDF"), (k % 4 != 3, LETTER, "授权书_", dn, ".pdf"), (k % 3 == 0, LIST, "对账单_", dn, ".pdf"))
    # names are made in the array: conditions on an exploded one do not write its making out again
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("kind"), F.concat(F.lit(head), key, F.lit(end)).alias("file_name"))) for test, i, head, key, end in kinds]))
    return orders.select("*", F.explode(each).alias("d")).withColumns({"kind": F.col("d.kind"), "doc_seq": F.col("k") * 10 + F.col("d.kind"), "file_name": F.col("d.file_name")}).drop("d")


def documents(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """``(k, doc_seq, file_name, full_text)``: up to four documents of an order; only a document's own text is written."""
    k, kind, dn = F.col("k"), F.col("kind"), _number(F.col("k"))
    day = F.date_add("ship", F.when(k % 12 == 5, 1).otherwise(0))
    signer, sign = F.element_at(F.array(*[F.lit(p) for p in PEOPLE]), (k % 4 + 1).cast("int")), F.date_add("ship", 2)
    contract = F.concat(
        F.when(k % 14 == 9, "乙方：").otherwise("甲方："), F.when(k % 10 == 3, "Another Company").otherwise(F.col("customer")), F.lit("\n产品名称："), F.col("item.material_name"), F.lit("\n规格型号："), F.when(k % 7 == 1, "X-1").otherwise(F.upper("item.spec_model")),
        F.when(k % 20 == 7, "\n售价：").when(k % 20 == 9, "\n单价 ").otherwise("\n含税单价："), (F.col("item.price") + F.when(k % 11 == 0, 10).otherwise(0)).cast("decimal(20,4)").cast("string"), F.lit("\n"),
    )
    receipt = F.concat(
        F.lit("出库单号："), F.when(k % 19 == 0, "ZB999999999").otherwise(dn), F.when(k % 21 == 2, "\n数量 ").otherwise("\n合计："), (F.col("n") + F.when(k % 6 == 1, 1).otherwise(0)).cast("string"), F.lit("件\n"), F.when(k % 27 == 3, F.date_format(day, "制单日期：yyyyMMdd")).otherwise(F.date_format(day, "出库日期：yyyy-MM-dd")),
        F.when(k % 24 == 6, "\n物流公司：顺丰速运\n物流单号：SF-").otherwise("\n物流公司：顺丰速运\n物流单号：SF"), F.lpad(k.cast("string"), 10, "0"), F.when(k % 27 == 3, "\n签收 ").otherwise("\n签收日期："), F.when(k % 3 == 0, F.date_format(sign, "M/d")).otherwise(F.date_format(sign, "yyyy/MM/dd")),
        F.when(k % 26 == 8, "\n客户签章：").otherwise("\n签收人："), signer, F.when(k % 2 == 0, F.concat(F.lit("\n客户名称："), F.col("customer"))).otherwise(""), F.lit("\n"),
    )
    person = F.when(k % 3 == 1, "孙七").otherwise(signer)
    letter = F.when(k % 8 == 4, F.concat(F.lit("被授权人："), person, F.lit("\n"))).otherwise(F.concat(F.lit("兹授权 "), person, F.lit(" 为我司签收代表\n")))
    text = F.when(kind == CONTRACT, contract).when(kind == RECEIPT, receipt).when(kind == LETTER, letter).otherwise("")
    return files(order_facts(spark, sf_dir, rows)).select("k", "doc_seq", "file_name", text.alias("full_text"))


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """File names and delivery numbers, which is what matching reads: of the joins only the orders' keys are written, once for both."""
    orders = stored(_lines(spark, sf_dir).select("k").distinct())
    return files(orders).select("file_name"), delivery_numbers(orders.select(_number(F.col("k")).alias("delivery_no")))


def classified(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return classify_documents(documents(spark, sf_dir, rows).drop("k"))


def assigned(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = sample(spark, sf_dir) if rows is None else rows
    # groups and the documents' fields are written once: matching reads them several times
    g, d = stored(groups(spark, sf_dir, rows)), stored(classified(spark, sf_dir, rows).drop("full_text"))
    return assign_documents(g, d)


def verified(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return verify(assigned(spark, sf_dir, rows))
