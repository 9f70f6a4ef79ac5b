"""Summaries and the filled sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .checks import CHECKS, PASS


def summarize(verified: DataFrame) -> DataFrame:
    """One row: groups, checked groups, passes and failures of each check, groups that pass all."""
    counts = [x for c in CHECKS for x in (F.count_if(F.col(c) == PASS).alias(f"{c}_pass"), F.count_if(F.col(c) != PASS).alias(f"{c}_fail"))]
    return verified.agg(F.count("*").alias("total_groups"), F.count("*").alias("total_checked"), *counts, F.count_if("all_pass").alias("all_pass"))


def pass_rate(summary: DataFrame) -> DataFrame:
    """Share of the checked groups that pass all (0 if none was checked), as a number and in whole per cent, and the exceptions."""
    rate = F.when(F.col("total_checked") > 0, F.col("all_pass") / F.col("total_checked")).otherwise(F.lit(0.0))
    return summary.select("total_checked", "all_pass", rate.alias("pass_rate"), F.concat(F.bround(rate * 100, 0).cast("int").cast("string"), F.lit("%")).alias("pass_rate_text"), (F.col("total_checked") - F.col("all_pass")).alias("exceptions"))


def per_check(summary: DataFrame) -> DataFrame:
    """A row for each check: passed and failed groups."""
    rows = ", ".join(f"'{c}', {c}_pass, {c}_fail" for c in CHECKS)
    return summary.selectExpr(f"stack({len(CHECKS)}, {rows}) as (check_name, passed, failed)")


def result_summary(verified: DataFrame) -> DataFrame:
    """The result list: ten columns under their headings."""
    heads = ("①合同", "②出库单", "③金额", "④时点", "⑤授权")
    return verified.select(
        F.col("delivery_no").alias("出库单号"), F.col("customer_name").alias("客户名称"), F.col("total_qty").alias("出库数量"), F.col("total_revenue_tax").cast("string").alias("含税收入"),
        *[F.col(c).alias(h) for c, h in zip(CHECKS, heads, strict=True)], F.when(F.col("all_pass"), "全部通过").otherwise("存在异常").alias("总结"),
    )


OUTPUTS = ("logistics_company", "logistics_no", "customer_sign_date", "signer", *CHECKS, "attachment_index", "attachment_result")


def result_rows(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """The sample rows with columns R to AC of their group; the logistics sign date is never filled. Rows without a group keep nulls.

    ``rows`` and ``verified`` meet on the stripped delivery number and the row index, an equi-join.
    """
    results = verified.select(F.explode("row_indices").alias("row_idx"), "delivery_no", *OUTPUTS)
    left = rows.withColumn("__key", strip(F.col("delivery_no")))
    out = left.join(results.withColumnRenamed("delivery_no", "__key"), ["__key", "row_idx"], "left").drop("__key")
    return out.withColumn("logistics_sign_date", F.lit(None).cast("string"))


def matched_count(assigned: DataFrame) -> DataFrame:
    """How many groups have a contract or a receipt."""
    return assigned.agg(F.count_if(F.col("contract").isNotNull() | F.col("receipt").isNotNull()).alias("matched"), F.count("*").alias("total"))
