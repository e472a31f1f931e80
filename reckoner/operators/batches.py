"""Payout batches rebuilt from report rows, and groups of them behind one credit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import merged

KEY = ["merchant_id", "settlement_id"]
CREDIT = ["merchant_id", "credit_id"]
#: Additive measures of a batch; a group's are their sums.
MEASURES = ("rows", "payments", "gross", "fee", "tax", "debit_fee", "debit_tax", "debits", "refund_principal", "pay_credit", "expected_net", "allowance")


def rebuild(rows: DataFrame) -> DataFrame:
    """One row for each settlement with a date: reference, day, money measures and rounding allowance.

    Fee and tax are those of payments. The allowance is half a paisa for each
    taxed payment and for the batch, in whole paise, and one more.
    """
    pay = F.col("type") == "payment"
    of_pay = lambda name: F.sum(F.when(pay, F.col(name)).otherwise(0))
    of_debit = lambda name: F.sum(F.when(pay, 0).otherwise(F.col(name)))
    taxed = F.count_if(pay & (F.col("tax") != 0))
    grouped = rows.filter("settlement_id IS NOT NULL").groupBy(*KEY).agg(
        F.min_by("settlement_utr", F.when(F.col("settlement_utr") != "", F.col("entity_id"))).alias("settlement_utr"),
        F.min_by("settled_on", F.when(F.col("settled_on").isNotNull(), F.col("entity_id"))).alias("settled_on"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(pay).alias("payments"),
        of_pay("amount").alias("gross"),
        of_pay("fee").alias("fee"),
        of_pay("tax").alias("tax"),
        of_debit("fee").alias("debit_fee"),
        of_debit("tax").alias("debit_tax"),
        of_debit("debit").alias("debits"),
        of_pay("credit").alias("pay_credit"),
        F.sum(F.col("credit") - F.col("debit")).alias("expected_net"),
        (F.floor((taxed + 1) / 2) + 1).cast("long").alias("allowance"),
    )
    return (
        grouped.filter("settled_on IS NOT NULL")
        .withColumn("refund_principal", F.col("debits") - F.col("debit_fee") - F.col("debit_tax"))
    )


def pending(rows: DataFrame) -> DataFrame:
    """Rows that no payout has taken up yet."""
    return rows.filter("settlement_id IS NULL")


def group_claims(claims: DataFrame, batches: DataFrame) -> DataFrame:
    """For each claim (credit, settlement_ids): sums over its batches, first and last day, sorted ids.

    `explained` is what a proof's lines add up to: credits of payments less debits of all else.
    """
    long = merged(claims.select(*CREDIT, F.explode("settlement_ids").alias("settlement_id"))).join(batches, KEY)
    sums = [F.sum(m).alias(m) for m in MEASURES]
    grouped = long.groupBy(*CREDIT).agg(
        *sums,
        F.min("settled_on").alias("opened_on"),
        F.max("settled_on").alias("settled_on"),
        F.sort_array(F.collect_list("settlement_id")).alias("settlement_ids"),
        F.count(F.lit(1)).alias("members"),
    )
    return grouped.withColumn("explained", F.col("pay_credit") - F.col("debits"))


def report_complete_to(rows: DataFrame) -> DataFrame:
    """The last day a merchant's report has anything to say about."""
    return rows.filter("settled_on IS NOT NULL").groupBy("merchant_id").agg(F.max("settled_on").alias("complete_to"))
