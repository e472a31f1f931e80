"""Fees above contract, on rows that reconcile perfectly."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import RATE, apply_rate
from ..functions.rates import platform_rate
from .members import MOST_SHOWN, shown


def charged_above_contract(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Payment rows whose fee exceeds the contracted rate to the paisa."""
    cards = rates.select("merchant_id", "standard", "corporate_card", "international_card")
    contracted = platform_rate(F.col("method"), F.col("card_type"), F.col("standard"), F.col("corporate_card"), F.col("international_card"))
    found = (
        rows.filter("type = 'payment' AND amount > 0 AND method IS NOT NULL")
        .join(cards, "merchant_id")
        .withColumn("contracted_rate", contracted.cast(RATE))
        .withColumn("contracted_fee", apply_rate(F.col("amount"), F.col("contracted_rate")))
        .filter("fee > contracted_fee")
    )
    over = F.col("fee") - F.col("contracted_fee")
    impact = F.bround(over.cast("decimal(20,0)") * F.lit("1.18").cast("decimal(3,2)"), 0).cast("long")
    return found.select(
        "merchant_id",
        F.coalesce("payment_id", "entity_id").alias("payment_id"),
        F.coalesce("settlement_id", F.lit("")).alias("settlement_id"),
        F.col("amount").alias("gross"),
        F.col("fee").alias("charged_fee"),
        "contracted_fee",
        F.bround(F.col("fee").cast("decimal(28,8)") / F.col("amount").cast("decimal(20,0)"), 4).cast(RATE).alias("charged_rate"),
        "contracted_rate",
        "method",
        "card_type",
        "card_network",
        "settled_on",
        over.alias("overcharge"),
        (impact - over).alias("gst_on_overcharge"),
    )


def clusters(leaks: DataFrame, most: int | None = MOST_SHOWN) -> DataFrame:
    """Leaks by the pair of rates that caused them: counts, money, days, networks by frequency, the first payment ids (most: how many, None for all). The leaks themselves name their cluster."""
    key = ["merchant_id", "contracted_rate", "charged_rate", "method", "card_type"]
    networks = leaks.filter("card_network IS NOT NULL").groupBy(*key, "card_network").agg(F.count(F.lit(1)).alias("n"))
    order = networks.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "card_network"))), lambda x: x["card_network"]).alias("networks"))
    few = shown(leaks, key, "payment_id", "payment_ids", most)
    grouped = leaks.groupBy(*key).agg(
        F.count(F.lit(1)).alias("payments"), F.sum("overcharge").alias("overcharge"), F.sum("gst_on_overcharge").alias("gst"), F.sum("gross").alias("gross_affected"),
        F.min("settled_on").alias("first_seen"), F.max("settled_on").alias("last_seen"),
    )
    for part in (order, few):
        theirs = part.select(*[F.col(c).alias(f"_{c}") for c in key], part.columns[-1])
        same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
        grouped = grouped.join(theirs, same, "left").drop(*[f"_{c}" for c in key])
    return grouped.select(*key, "payments", "overcharge", "gst", "gross_affected", "first_seen", "last_seen", F.coalesce("networks", F.array().cast("array<string>")).alias("networks"), "payment_ids")


def totals(leaks: DataFrame, rows: DataFrame) -> DataFrame:
    """The headline of each merchant that has rows: leaking payments, overcharge, tax on it, rows examined."""
    examined = rows.groupBy("merchant_id").agg(F.count_if(F.col("type") == "payment").alias("rows_examined"))
    found = leaks.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("payments"), F.sum("overcharge").alias("overcharge"), F.sum("gst_on_overcharge").alias("gst"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return examined.join(found, "merchant_id", "left").select("merchant_id", "rows_examined", zero("payments"), zero("overcharge"), zero("gst"), (F.coalesce("overcharge", F.lit(0)) + F.coalesce("gst", F.lit(0))).alias("cash_impact"))
