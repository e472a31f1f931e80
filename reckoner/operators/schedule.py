"""Dating money already captured, and grading the dates against what landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import DOMESTIC_DAYS, INTERNATIONAL_DAYS, settlement_due, working_days_between
from ..functions.rates import deductions, platform_rate


def as_of_days(payments: DataFrame, days_back: int = 0) -> DataFrame:
    """The day each merchant's files describe: the last capture, or some days before."""
    return payments.groupBy("merchant_id").agg(F.date_sub(F.max("captured_on"), days_back).alias("as_of"))


def settled_ids(rows: DataFrame, as_of: DataFrame) -> DataFrame:
    """Payments already paid out on the day, under either id of their row."""
    paid = rows.filter("type = 'payment' AND settled_on IS NOT NULL").join(as_of, "merchant_id").filter("settled_on <= as_of")
    ids = F.explode(F.array_distinct(F.array_compact(F.array("entity_id", "payment_id"))))
    return paid.select("merchant_id", ids.alias("payment_id")).distinct()


def routed_by(rows: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """What was paid on out of each payment, by the day if one is given."""
    transfers = rows.filter("type = 'transfer' AND payment_id IS NOT NULL")
    if as_of is not None:
        transfers = transfers.join(as_of, "merchant_id").filter("created_on <= as_of")
    return transfers.groupBy("merchant_id", "payment_id").agg(F.sum("debit").alias("routed"))


def commitments(payments: DataFrame, rows: DataFrame, rates: DataFrame, as_of: DataFrame) -> DataFrame:
    """Captured and not paid out: due day, net of the fee stack and of what is routed on, overdue or not."""
    open_ = payments.join(as_of, "merchant_id").filter("captured_on <= as_of").join(settled_ids(rows, as_of), ["merchant_id", "payment_id"], "left_anti")
    open_ = open_.join(routed_by(rows, as_of), ["merchant_id", "payment_id"], "left").join(rates, "merchant_id", "left")
    contracted = platform_rate(F.col("method"), F.col("card_type"), F.col("standard"), F.col("corporate_card"), F.col("international_card"))
    net = deductions(F.col("amount"), contracted, F.col("gst"), F.col("tds"), F.col("tds_applies"))["net"]
    routed = F.coalesce("routed", F.lit(0).cast("long"))
    return open_.withColumn("due", settlement_due(F.col("captured_on"), F.col("card_type"))).select(
        "merchant_id", "payment_id", "as_of", "captured_on", "due",
        F.when(F.col("card_type") == "international", INTERNATIONAL_DAYS).otherwise(DOMESTIC_DAYS).alias("cycle_days"),
        F.col("amount").alias("gross"), routed.alias("routed"), (net - routed).alias("net"), (F.col("due") <= F.col("as_of")).alias("overdue"),
    )


def landings(dated: DataFrame) -> DataFrame:
    """Money due on each day, with the running total."""
    by_day = dated.filter("NOT overdue").groupBy("merchant_id", "due").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("gross").alias("gross"), F.sum(F.col("gross") - F.col("net") - F.col("routed")).alias("deducted"), F.sum("routed").alias("routed"), F.sum("net").alias("net")
    )
    so_far = Window.partitionBy("merchant_id").orderBy("due").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.withColumn("through", F.sum("net").over(so_far))


def undated(rows: DataFrame, as_of: DataFrame) -> DataFrame:
    """Cash effects that the files prove and give no date for."""
    why = (
        F.when(F.col("on_hold"), "on hold at the gateway")
        .when(F.col("type") == "refund", "netted out of the next payout large enough")
        .when(F.col("type") == "adjustment", "recovered from a payout not named yet")
        .otherwise("reported without a settlement date")
    )
    open_ = rows.join(as_of, "merchant_id").filter("created_on <= as_of AND settled_on IS NULL AND credit <> debit")
    return open_.select("merchant_id", F.col("entity_id").alias("subject_id"), F.col("type").alias("kind"), (F.col("credit") - F.col("debit")).alias("amount"), why.alias("because"))


def grade(dated: DataFrame, rows: DataFrame) -> DataFrame:
    """Each dated commitment against the row that eventually settled it: working days out, error in paise."""
    landed = rows.filter("type = 'payment' AND settled_on IS NOT NULL").withColumn("key", F.coalesce("payment_id", "entity_id"))
    landed = landed.join(routed_by(rows).withColumnRenamed("payment_id", "key"), ["merchant_id", "key"], "left")
    actual = landed.select("merchant_id", F.explode(F.array_distinct(F.array("key", "entity_id"))).alias("payment_id"), F.col("settled_on").alias("landed_on"), (F.col("credit") - F.col("debit") - F.coalesce("routed", F.lit(0))).alias("actual"))
    joined = dated.filter("NOT overdue").join(actual, ["merchant_id", "payment_id"], "left")
    return joined.select(
        "merchant_id", "payment_id", "due", F.col("net").alias("predicted"), "landed_on", F.coalesce("actual", F.lit(0).cast("long")).alias("actual"),
        F.when(F.col("landed_on").isNotNull(), working_days_between(F.col("due"), F.col("landed_on"))).alias("days_out"),
    ).withColumn("error", F.col("actual") - F.col("predicted"))


def accuracy(graded: DataFrame) -> DataFrame:
    """What a merchant's schedule got right, over everything it dated."""
    arrived = F.col("landed_on").isNotNull()
    share = lambda hit, of: F.coalesce(F.try_divide(hit, of), F.lit(0.0))
    n, came = F.count(F.lit(1)), F.count_if(arrived)
    money = F.sum("predicted")
    return graded.groupBy("merchant_id").agg(
        n.alias("checked"), came.alias("arrived"),
        share(F.count_if(F.col("days_out") == 0), n).alias("on_the_day"),
        share(F.count_if(F.abs("days_out") <= 1), n).alias("within_a_day"),
        share(F.sum(F.when(F.col("days_out") == 0, F.col("predicted")).otherwise(0)), F.when(money > 0, money)).alias("money_on_the_day"),
        share(F.count_if(arrived & (F.col("error") == 0)), came).alias("to_the_paisa"),
        F.sum(F.when(arrived, 0).otherwise(F.col("predicted"))).alias("missing"),
        F.sum(F.when(arrived, F.col("error")).otherwise(0)).alias("error_on_arrivals"),
    )
