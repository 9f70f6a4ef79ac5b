"""Queries over the audit model, with equivalent DuckDB SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compare, text
from ..functions.amounts import parse_amount
from ..functions.dates import parse_date, parse_short_date
from ..operators import checks, extraction, grouping, layout, matching, report
from ..sources.files import list_files
from ..tables import read_table, stored
from . import demo, oracle

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _files(s: SparkSession, d: str) -> DataFrame:
    return demo.documents(s, d).select("file_name")


def delivery_groups(s, d):
    g = demo.groups(s, d)
    return g.select("delivery_no", "first_row", F.array_join(F.transform("row_indices", lambda i: i.cast("string")), ",").alias("row_list"), "customer_name", "material_name", "spec_model", F.col("unit_price").cast("string").alias("unit_price"), "total_qty", F.col("total_revenue_tax").cast("string").alias("total_revenue_tax"), F.col("total_revenue_notax").cast("string").alias("total_revenue_notax"), "delivery_date", "confirm_date")


def amount_parse(s, d):
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = read_table(s, d, "lineitem").select(*KEYS, c.alias("c"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).alias("f"))
    whole, cents = F.expr("c div 100"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    grouped = lambda mark: F.when(whole >= 1000, F.concat(F.expr("c div 100000").cast("string"), F.lit(mark), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    plain, comma = F.concat(whole.cast("string"), F.lit("."), cents), F.concat(grouped(","), F.lit("."), cents)
    forms = (plain, comma, F.concat(F.lit("("), comma, F.lit(")")), F.concat(F.lit("¥"), comma), F.concat(F.lit("CNY "), comma), F.concat(F.lit("-"), plain), F.concat(grouped("."), F.lit(","), cents), F.concat(F.lit("RMB"), whole.cast("string"), F.lit(","), cents))
    return rows.select(*KEYS, parse_amount(F.element_at(F.array(*forms), (F.col("f") + 1).cast("int")), 6).cast("string").alias("amount"))


def date_parse(s, d):
    forms = ("yyyy-MM-dd", "yyyy年M月d日", "yyyy.MM.dd", "yyyyMMdd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yy-MM-dd")
    written = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in forms]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return read_table(s, d, "orders").select("o_orderkey", parse_date(written).alias("d"))


def short_date(s, d):
    reference = F.concat((F.year("o_orderdate") + 1).cast("string"), F.lit("/06/15"))
    return read_table(s, d, "orders").select("o_orderkey", parse_short_date(F.date_format("o_orderdate", "M/d"), reference).cast("string").alias("d"))


def clean_text(s, d):
    clean = text.clean_text(F.col("text"))
    return read_table(s, d, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("n"))


def fullwidth(s, d):
    wide = F.replace(F.replace(F.replace("p_name", F.lit(" "), F.lit("（")), F.lit("e"), F.lit("：")), F.lit("a"), F.lit("，　"))
    return read_table(s, d, "part").select("p_partkey", text.normalize_fullwidth(wide).alias("folded"))


def detect_language(s, d):
    mixed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("收入"), (F.col("doc_id") % 40).cast("int")), F.col("text"))).otherwise(F.col("text"))
    return read_table(s, d, "documents").select("doc_id", mixed.alias("x")).select("doc_id", text.count_cjk_chars(F.col("x")).alias("cjk"), text.detect_language(F.col("x")).alias("language"))


def receipt_fields(s, d):
    return demo.classified(s, d).where("doc_type = 'receipt'").select("file_name", "delivery_no", "delivery_qty", "delivery_date", "logistics_company", "logistics_no", "sign_date", "signer", "customer_name")


def contract_fields(s, d):
    return demo.classified(s, d).where("doc_type = 'contract'").select("file_name", "customer_name", "product_name", "spec_model", F.col("unit_price").cast("string").alias("unit_price"))


def match_suffix(s, d):
    f, g = demo.names(s, d)
    return matching.match_suffix(f, g, matching.match_direct(f, g))


def match_direct(s, d):
    return matching.match_direct(*demo.names(s, d))


def assign_first_doc(s, d):
    return demo.assigned(s, d).select("delivery_no", *[F.col(f"{t}.doc_seq").cast("string").alias(f"{t}_seq") for t in matching.TYPES])


def check_amount(s, d):
    """The amount check compares a group with itself, so no document is read."""
    found = demo.groups(s, d).select("delivery_no", checks.amount_findings().alias("found"))
    return found.select("delivery_no", checks.codes(F.col("found")).alias("codes"), checks.message(F.col("found")).alias("message"))


def _check(i: int):
    return lambda s, d: demo.verified(s, d).select("delivery_no", F.col(f"check{i}_codes").alias("codes"), F.col(f"check{i}").alias("message"))


def pass_rate(s, d):
    rate = report.pass_rate(report.summarize(demo.verified(s, d)))
    return rate.select("total_checked", "all_pass", F.floor(F.col("all_pass") * 1000000.0 / F.col("total_checked")).cast("long").alias("rate_ppm"), "exceptions")


def result_rows(s, d):
    rows = demo.sample(s, d)
    out = report.result_rows(rows.select("delivery_no", "row_idx"), demo.verified(s, d, rows))
    return out.select("delivery_no", "row_idx", *report.OUTPUTS)


def compare_amounts(s, d):
    e = F.round(F.col("l_extendedprice") * 100).cast("long").cast("decimal(20,0)")
    k = F.col("l_orderkey") % 5
    a = e + F.when(k == 0, 0).when(k == 1, 1).when(k == 2, 2000).when(k == 3, -150000).otherwise(7)
    money = lambda x: (x.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("string")
    return compare.with_amounts_compared(read_table(s, d, "lineitem"), money(a), money(e)).select(*KEYS, "matches", "difference")


def compare_dates(s, d):
    k = (F.col("o_orderkey") % 6).cast("int")
    r = compare.compare_dates(F.date_format(F.date_add("o_orderdate", k), "yyyy/MM/dd"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("r")
    return read_table(s, d, "orders").select("o_orderkey", r).select("o_orderkey", "r.matches", F.round(F.col("r.confidence") * 1000).cast("long").alias("confidence_milli"), "r.difference")


def compare_text(s, d):
    r = compare.compare_text(F.col("p_name"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"))).alias("r")
    return read_table(s, d, "part").select("p_partkey", r).select("p_partkey", "r.matches", F.round("r.confidence", 6).alias("confidence"))


def auto_compare(s, d):
    r = compare.auto_compare(F.col("s_name"), F.concat(F.col("s_name"), F.lit("0"))).alias("r")
    return read_table(s, d, "supplier").select("s_suppkey", r).select("s_suppkey", "r.matches", "r.notes")


def decimal_compare(s, d):
    a = F.col("l_extendedprice").cast("decimal(20,4)")
    b = a + (F.col("l_orderkey") % 4).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(3,2)")
    return read_table(s, d, "lineitem").select(*KEYS, compare.safe_decimal_compare(a, b, Decimal("0.01")).alias("same"))


def document_page_types(s, d):
    ratio = F.when(F.col("page_id") % 3 == 0, 0.5).otherwise(0.0)
    pages = read_table(s, d, "pages").select((F.col("page_id") % 40).alias("doc_id"), F.col("page_id").alias("page_number"), layout.page_type(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(" of the book")), ratio).alias("page_type"))
    return layout.document_page_types(pages).select("doc_id", F.array_join("page_types", ",").alias("page_types"))


def sheet_head(s, d):
    return grouping.head(read_table(s, d, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderstatus").alias("status")))


def page_types(s, d):
    both = F.explode(F.array(F.struct(F.lit("html").alias("what"), F.col("html").alias("t")), F.struct(F.lit("url").alias("what"), F.col("url").alias("t"))))
    pages = read_table(s, d, "pages").select("page_id", both.alias("x")).select("page_id", "x.*")
    return pages.select("page_id", "what", layout.page_type(F.col("t"), layout.image_ratio((F.col("page_id") % 10).cast("double"), F.lit(10.0), F.lit(1.0))).alias("page_type"))


def ocr_routing(s, d):
    k = F.col("page_id") % 4
    p = read_table(s, d, "pages").select("page_id", F.col("page_id").alias("page_number"), F.when(k == 0, "scanned").when(k == 3, "native").otherwise("mixed").alias("page_type"), F.when(k == 1, "").otherwise("native").alias("native_text"), F.lit("ocr").alias("ocr_text"), ((F.col("page_id") % 10) / 10.0).alias("ocr_confidence"))
    return layout.route_text(p).select("page_id", "text", "warning")


def rows_cluster(s, d):
    spans = read_table(s, d, "events").select("user_id", F.col("event_id").alias("seq"), ((F.col("event_id") % 701).cast("double") / 4).alias("y0"))
    return layout.cluster_rows(spans, ["user_id"]).select("user_id", F.col("seq").alias("event_id"), "row_no")


def columns_detect(s, d):
    found = layout.detect_columns(F.collect_list((F.col("event_id") % 601).cast("double")))
    return read_table(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(found, lambda x: x.cast("bigint").cast("string")), ",").alias("columns"))


def table_confidence(s, d):
    cells = read_table(s, d, "events").select("user_id", F.when((F.col("event_id") % 4 == 0) | (F.col("user_id") % 5 == 0), "").otherwise(F.col("event_type")).alias("value"))
    return layout.table_confidence(cells, ["user_id"]).select("user_id", F.round(F.col("confidence") * 100000).cast("long").alias("confidence"))


def header_dedup(s, d):
    heads = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_type")).alias("h")))), lambda x: x["h"])
    return read_table(s, d, "part").groupBy("p_brand").agg(heads.alias("h")).select("p_brand", F.md5(F.array_join(layout.unique_headers(F.col("h")), "|")).alias("headers"))


def ocr_blocks(s, d):
    words = read_table(s, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("text"), (F.col("event_id") % 103 - 3).cast("double").alias("conf"))
    return layout.ocr_blocks(words, ["user_id"]).select("user_id", "block_no", "content", F.round(F.col("confidence") * 1000000).cast("long").alias("confidence"))


def ocr_best_mode(s, d):
    modes = read_table(s, d, "events").groupBy("user_id", (F.col("event_id") % 3).cast("int").alias("mode_no")).agg((F.sum(F.col("event_id") % 97).cast("double") / F.count("*") / 100).alias("confidence"))
    return layout.best_mode(modes, ["user_id"]).select("user_id", "mode_no", F.round(F.col("confidence") * 1000000).cast("long").alias("confidence"))


def full_text(s, d):
    return layout.full_text(read_table(s, d, "conversations"), "conv_id", "turn").select("conv_id", F.md5("full_text").alias("text_md5"))


def _cells(s, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    price = (F.round(F.col("l_extendedprice") * 100).cast("long").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("string")
    rows = read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_name"), F.row_number().over(order).alias("row_idx"), F.floor("l_quantity").cast("string").alias("q"), price.alias("p"))
    each = F.array(F.struct(F.lit(0).alias("col_idx"), F.lit("数量").alias("header"), F.col("q").alias("value")), F.struct(F.lit(1).alias("col_idx"), F.lit("含税单价").alias("header"), F.col("p").alias("value")))
    return rows.select("file_name", F.lit(0).alias("table_idx"), "row_idx", F.inline(each))


def table_prices(s, d):
    return extraction.table_prices(_cells(s, d)).select(F.col("file_name").alias("l_orderkey"), (F.col("table_price") * 100).cast("long").alias("cents"))


def file_listing(s, d):
    p = read_table(s, d, "pages").select(F.concat(F.lit("file:/data/"), F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path"), F.length("html").alias("length"))
    return list_files(p, "/data")


def column_letters(s, d):
    n = F.col("n_nationkey")
    letters = F.when(n < 13, F.char(n + 65)).otherwise(F.concat(F.lit("A"), F.char(n + 64)))
    return read_table(s, d, "nation").select("n_nationkey", text.column_index(letters).alias("idx"))


def interface_texts(s, d):
    key = F.when(F.col("r_regionkey") == 0, "summary").when(F.col("r_regionkey") == 1, "matched").otherwise(F.col("r_name"))
    return read_table(s, d, "region").select("r_regionkey", text.translate_key(key, "en").alias("english"), text.translate_key(key, "xx").alias("chinese"))


def nearest_column(s, d):
    columns = F.array(*[F.lit(float(c)) for c in (0, 60, 135, 300)])
    return read_table(s, d, "events").select("event_id", layout.nearest_column((F.col("event_id") % 500).cast("double"), columns).cast("string").alias("col_no"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.verified(spark, sf_dir).select("delivery_no", "check1", "check2", "check3", "check4", "check5", "attachment_index", "attachment_result")


def queries() -> dict:
    named = [delivery_groups, amount_parse, date_parse, short_date, clean_text, fullwidth, detect_language, contract_fields, receipt_fields, match_suffix, assign_first_doc, pass_rate, result_rows, compare_amounts, compare_dates, compare_text, auto_compare, decimal_compare, document_page_types, sheet_head, page_types, ocr_routing, rows_cluster, columns_detect, nearest_column, table_confidence, header_dedup, ocr_blocks, ocr_best_mode, full_text, table_prices, file_listing, column_letters, interface_texts]
    return {f.__name__: f for f in named} | {
        "group_preview": lambda s, d: grouping.preview(demo.groups(s, d)),
        "truncate_text": lambda s, d: read_table(s, d, "documents").select("doc_id", text.truncate_text(F.col("text")).alias("short")),
        "doc_classify": lambda s, d: _files(s, d).select("file_name", matching.document_type(F.col("file_name")).alias("doc_type")),
        "authorization_fields": lambda s, d: demo.classified(s, d).where("doc_type = 'authorization'").select("file_name", "authorized_person"),
        "match_direct": match_direct,
        "match_status": lambda s, d: matching.match_status(demo.assigned(s, d)),
        **{f"check{i}_{name}": _check(i) for i, name in enumerate(("contract", "delivery", "amount", "timing", "signer"), 1) if i != 3},
        "check3_amount": check_amount,
        "attachment_index": lambda s, d: demo.verified(s, d).select("delivery_no", "attachment_index", "attachment_result"),
        "verification_summary": lambda s, d: report.summarize(demo.verified(s, d)),
        "per_check_table": lambda s, d: report.per_check(report.summarize(demo.verified(s, d))),
        "matched_count": lambda s, d: report.matched_count(demo.assigned(s, d)),
        "result_summary": lambda s, d: report.result_summary(demo.verified(s, d)),
        "block_types": lambda s, d: read_table(s, d, "events").select("event_id", layout.block_type((F.col("event_id") % 800).cast("double"), F.lit(792.0)).alias("block_type")),
        "table_quantities": lambda s, d: extraction.table_quantities(_cells(s, d)).select(F.col("file_name").alias("l_orderkey"), "table_qty"),
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
