"""Rebuilding a credit line by line, and what is left when it will not close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import apply_rate
from ..sources.session import merged
from .batches import CREDIT, KEY, group_claims


def _sum(when: Column, value: Column) -> Column:
    return F.sum(F.when(when, value).otherwise(0))


def _refs(when: Column) -> Column:
    return F.sort_array(F.collect_list(F.when(when, F.col("entity_id"))))


def _percent(rate: Column, places: int) -> Column:
    return F.concat(F.format_number((rate * 100).cast("double"), places), F.lit("%"))


def proof_lines(claims: DataFrame, credits: DataFrame, rows: DataFrame, batches: DataFrame, rates: DataFrame) -> DataFrame:
    """credit, line_no, label, amount, refs: what happened to the money, in order; lines of nothing are left out."""
    long = claims.select(*CREDIT, F.explode("settlement_ids").alias("settlement_id")).join(rows, KEY).join(rates.select("merchant_id", "gst", "tds", "route"), "merchant_id")
    kind, fee, tax = F.col("type"), F.col("fee"), F.col("tax")
    pay = kind == "payment"
    held = F.when(pay, F.col("amount") - fee - tax - F.col("credit")).otherwise(0)
    statutory = (held == 0) | (held == apply_rate(F.col("amount"), F.col("tds")))
    charged = (fee != 0) | (tax != 0)
    instant = charged & ~kind.isin("payment", "transfer")
    routed = charged & (kind == "transfer")
    returned = F.col("debit") - fee - tax
    sums = long.groupBy(*CREDIT).agg(
        F.first("gst").alias("gst"), F.first("tds").alias("tds"), F.first("route").alias("route"),
        F.count_distinct("settlement_id").alias("members"), F.count_if(pay).alias("payments"),
        _sum(pay, F.col("amount")).alias("gross"), _refs(pay).alias("gross_refs"),
        _sum(pay, fee).alias("fee"), _refs(pay & (fee != 0)).alias("fee_refs"),
        _sum(pay, tax).alias("tax"), _refs(pay & (tax != 0)).alias("tax_refs"),
        F.sum(held).alias("held"), _refs(held != 0).alias("held_refs"), F.bool_and(statutory).alias("statutory"),
        *[c for k in ("refund", "adjustment", "transfer") for c in (F.count_if(kind == k).alias(f"{k}s"), _sum(kind == k, returned).alias(k), _refs(kind == k).alias(f"{k}_refs"))],
        F.count_if(instant).alias("instants"), _sum(instant, fee + tax).alias("instant"), _refs(instant).alias("instant_refs"),
        F.count_if(routed).alias("routeds"), _sum(routed, fee + tax).alias("routed"), _refs(routed).alias("routed_refs"),
    )
    totals = group_claims(claims, batches).select(*CREDIT, "explained", "allowance")
    g = sums.join(totals, CREDIT).join(credits.select(*CREDIT, F.col("amount").alias("credited")), CREDIT)
    gap = F.col("credited") - F.col("explained")

    def line(no: int, when: Column, label: Column, amount: Column, refs: str) -> Column:
        return F.when(when, F.struct(F.lit(no).alias("line_no"), label.alias("label"), amount.cast("long").alias("amount"), F.col(refs).alias("refs")))

    def counted(text: str, n: str, tail: str = "") -> Column:
        return F.concat(F.lit(f"{text} ("), F.col(n).cast("string"), F.lit(f"){tail}"))

    merged = F.when(F.col("members") > 1, F.concat(F.lit(" across "), F.col("members").cast("string"), F.lit(" settlements"))).otherwise("")
    lines = F.array(
        line(1, F.lit(True), F.concat(counted("Settled payments", "payments"), merged), F.col("gross"), "gross_refs"),
        line(2, F.col("fee") != 0, F.lit("Platform fee"), -F.col("fee"), "fee_refs"),
        line(3, F.col("tax") != 0, F.concat(F.lit("GST on platform fee @"), _percent(F.col("gst"), 0)), -F.col("tax"), "tax_refs"),
        line(4, F.size("held_refs") > 0, F.when(F.col("statutory"), F.concat(F.lit("TDS under Section 194-O @"), _percent(F.col("tds"), 0))).otherwise("Unattributed per-transaction deduction"), -F.col("held"), "held_refs"),
        line(5, F.col("refunds") > 0, counted("Refunds recovered", "refunds"), -F.col("refund"), "refund_refs"),
        line(6, F.col("adjustments") > 0, counted("Chargebacks and adjustments", "adjustments"), -F.col("adjustment"), "adjustment_refs"),
        line(7, F.col("transfers") > 0, counted("Routed to linked accounts", "transfers"), -F.col("transfer"), "transfer_refs"),
        line(8, F.col("instants") > 0, counted("Instant refund charges", "instants", ", incl. GST"), -F.col("instant"), "instant_refs"),
        line(9, F.col("routeds") > 0, F.concat(F.lit("Route commission @"), _percent(F.col("route"), 1), counted("", "routeds", ", incl. GST")), -F.col("routed"), "routed_refs"),
        line(10, (gap != 0) & (F.abs(gap) <= F.col("allowance")), F.lit("Rounding drift (per-transaction fee vs batch-level GST)"), gap, "tax_refs"),
    )
    return g.select(*CREDIT, F.explode(F.array_compact(lines)).alias("line")).select(*CREDIT, "line.*")


def prove(claims: DataFrame, credits: DataFrame, batches: DataFrame) -> DataFrame:
    """For each claim with strategy and confidence: amount, settlement_ids, explained, residual, proved, drift.

    A claim is proved if what its rows do not explain is within the allowance; that
    remainder is then its drift. Otherwise it is the shortfall (negative: too little came).
    """
    named = claims.select(*CREDIT, "strategy", "confidence")
    joined = group_claims(claims, batches).join(merged(named), CREDIT).join(merged(credits.select(*CREDIT, F.col("amount").alias("credit_amount"), "value_date")), CREDIT)
    gap = F.col("credit_amount") - F.col("explained")
    return joined.withColumn("residual", gap).withColumn("proved", F.abs(gap) <= F.col("allowance")).withColumn("drift", F.when(F.abs(gap) <= F.col("allowance"), gap).otherwise(0))


def running_balance(lines: DataFrame) -> DataFrame:
    """Lines with the balance so far; a proof's last balance is the credit."""
    so_far = Window.partitionBy(*CREDIT).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("running", F.sum("amount").over(so_far))


def missing_settlements(batches: DataFrame, proved: DataFrame, outcome: DataFrame) -> DataFrame:
    """Batches no credit was concluded for, with the first credit whose claim on them was withdrawn."""
    claimed = proved.select("merchant_id", F.explode("settlement_ids").alias("settlement_id")).distinct()
    named = (
        outcome.filter("verdict <> 'MATCHED'")
        .select("merchant_id", "credit_id", F.explode("withdrawn_ids").alias("settlement_id"))
        .groupBy(*KEY)
        .agg(F.min("credit_id").alias("claimed_by"))
    )
    that_day = batches.groupBy("merchant_id", "settled_on").agg(F.count(F.lit(1)).alias("batches_that_day"))
    return (
        batches.join(claimed, KEY, "left_anti")
        .join(named, KEY, "left")
        .join(that_day, ["merchant_id", "settled_on"])
        .withColumn("amount", F.when(F.col("claimed_by").isNotNull(), 0).otherwise(F.col("expected_net")))
    )


def reported_ids(rows: DataFrame) -> DataFrame:
    """Every payment or entity id that a report names."""
    return rows.select("merchant_id", F.col("entity_id").alias("payment_id")).union(rows.filter("payment_id IS NOT NULL").select("merchant_id", "payment_id")).distinct()
