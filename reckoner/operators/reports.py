"""Standing report questions over a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import CREDIT

MOST_LINES = 12


def cash_position(credits: DataFrame, proofs: DataFrame, queue: DataFrame) -> DataFrame:
    """What arrived, how much of it is proved, and what has not arrived."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    arrived = credits.groupBy("merchant_id").agg(F.sum("amount").alias("credited"))
    proved = proofs.groupBy("merchant_id").agg(F.sum("credit_amount").alias("proved"))
    awaited = queue.filter("code IN ('MISSING_SETTLEMENT', 'UNSETTLED_PAYMENT')").groupBy("merchant_id").agg(F.sum("amount").alias("awaited"))
    return arrived.join(proved, "merchant_id", "left").join(awaited, "merchant_id", "left").select("merchant_id", "credited", zero("proved"), zero("awaited"))


def run_summary(proofs: DataFrame, queue: DataFrame) -> DataFrame:
    """Exceptions by code, proofs, and what drift comes to, net and gross."""
    by_code = queue.groupBy("merchant_id", F.col("code").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    net = proofs.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("drift").alias("amount")).select("merchant_id", F.lit("proofs").alias("item"), "n", "amount")
    gross = proofs.filter("drift <> 0").groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("drift")).alias("amount")).select("merchant_id", F.lit("proofs with drift").alias("item"), "n", "amount")
    return by_code.unionByName(net).unionByName(gross)


def clip(lines: DataFrame, by: list[str], order: list, noun: str, most: int = MOST_LINES) -> DataFrame:
    """The first lines of each group (label, amount), and one line that counts the others."""
    placed = lines.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    shown = placed.filter(F.col("place") <= most).select(*by, "place", "label", "amount")
    rest = placed.groupBy(*by).agg((F.count(F.lit(1)) - most).alias("hidden")).filter("hidden > 0")
    rest = rest.select(*by, F.lit(most + 1).alias("place"), F.concat(F.lit("... and "), F.col("hidden").cast("string"), F.lit(f" more {noun}")).alias("label"), F.lit(None).cast("long").alias("amount"))
    return shown.unionByName(rest)


def charges(rows: DataFrame, withholding: DataFrame) -> DataFrame:
    """Fees, tax on them and, where withholding is held, what was withheld; the fee as a share of gross."""
    pay = F.col("type") == "payment"
    held = F.sum(F.when(pay, F.col("amount") - F.col("fee") - F.col("tax") - F.col("credit") + F.col("debit")).otherwise(0))
    g = rows.groupBy("merchant_id").agg(F.sum("fee").alias("fee"), F.sum("tax").alias("tax"), F.sum(F.when(pay, F.col("amount")).otherwise(0)).alias("gross"), held.alias("gap"))
    return g.join(withholding.select("merchant_id", "held"), "merchant_id").select(
        "merchant_id", "fee", "tax", F.when(F.col("held"), F.col("gap")).otherwise(0).alias("withheld"), "gross", F.round(F.try_divide("fee", "gross"), 6).alias("fee_share")
    )


def refunds(rows: DataFrame) -> DataFrame:
    """What went back out, and what sending it back cost."""
    back = rows.filter("type IN ('refund', 'adjustment')")
    of = lambda k: F.sum(F.when(F.col("type") == k, F.col("amount")).otherwise(0))
    return back.groupBy("merchant_id").agg(F.count_if(F.col("type") == "refund").alias("refunds"), of("refund").alias("refunded"), F.count_if(F.col("type") == "adjustment").alias("adjustments"), of("adjustment").alias("adjusted"), F.sum(F.col("fee") + F.col("tax")).alias("cost"))


def received(credits: DataFrame, proofs: DataFrame) -> DataFrame:
    """Bank credits by day, with how many are proved."""
    proved = proofs.select(*CREDIT, F.lit(1).alias("p"))
    return credits.join(proved, CREDIT, "left").groupBy("merchant_id", "value_date").agg(F.count(F.lit(1)).alias("credits"), F.sum("amount").alias("amount"), F.count("p").alias("proved"))


def by_size(queue: DataFrame, codes: list[str], most: int = MOST_LINES) -> DataFrame:
    """Exceptions of some codes, largest first."""
    found = queue.filter(F.col("code").isin(*codes)).withColumn("label", F.col("subject_id"))
    return clip(found, ["merchant_id"], [F.desc("amount"), "subject_id"], "cases", most)


def unexplained(causes: DataFrame, coverage: DataFrame) -> DataFrame:
    """The causes of a queue, and how many exceptions are each their own."""
    lines = causes.select("merchant_id", F.col("place").cast("int").alias("place"), F.col("cause").alias("label"), "members", F.col("total").alias("amount"))
    own = coverage.filter("exceptions > caused").select("merchant_id", F.lit(1_000_000).alias("place"), F.lit("each their own").alias("label"), (F.col("exceptions") - F.col("caused")).alias("members"), F.lit(None).cast("long").alias("amount"))
    return lines.unionByName(own)


def biggest(causes: DataFrame, queue: DataFrame) -> DataFrame:
    """The largest cause of each merchant, else its largest exception."""
    first = causes.filter("place = 1").select("merchant_id", F.col("cause").alias("what"), "members", F.col("total").alias("amount"))
    worst = queue.groupBy("merchant_id").agg(F.max_by(F.struct(F.col("summary").alias("what"), F.abs("amount").alias("amount")), F.struct(F.abs("amount"), "subject_id")).alias("w"))
    worst = worst.join(first, "merchant_id", "left_anti").select("merchant_id", "w.what", F.lit(1).cast("long").alias("members"), "w.amount")
    return first.unionByName(worst)


def by_method(rows: DataFrame) -> DataFrame:
    """What each instrument brought in, and what it cost."""
    g = rows.filter("type = 'payment' AND method IS NOT NULL").groupBy("merchant_id", "method").agg(F.sum("amount").alias("gross"), F.sum(F.col("fee") + F.col("tax")).alias("cost"), F.count(F.lit(1)).alias("payments"))
    return g.withColumn("cost_share", F.round(F.try_divide("cost", "gross"), 6))


def on_days(credits: DataFrame, rows: DataFrame, payments: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """What happened on each day: credits, payout runs, captures, and, of a queue, cases that name the day in their evidence."""
    line = lambda df, day, what, n, amount: df.groupBy("merchant_id", F.col(day).alias("on_day")).agg(n.alias("n"), amount.alias("amount")).withColumn("what", F.lit(what))
    one, none = F.count(F.lit(1)), F.lit(None).cast("long")
    happened = (
        line(credits, "value_date", "arrived", one, F.sum("amount"))
        .unionByName(line(rows.filter("settled_on IS NOT NULL AND settlement_id IS NOT NULL"), "settled_on", "payout runs", F.count_distinct("settlement_id"), none))
        .unionByName(line(payments, "captured_on", "captured", one, F.sum("amount")))
    )
    if queue is None:
        return happened
    named = queue.select("merchant_id", F.abs("amount").alias("amount"), F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", F.map_values("evidence")), F.lit(r"(\d{4}-\d{2}-\d{2})"), 1))).alias("on_day"))
    named = named.withColumn("on_day", F.col("on_day").try_cast("date")).filter("on_day IS NOT NULL")
    return happened.unionByName(line(named, "on_day", "cases", one, F.sum("amount")))


def largest(credits: DataFrame, proofs: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """The largest credits of each merchant, proved or not, with their share of everything received."""
    placed = Window.partitionBy("merchant_id").orderBy(F.desc("amount"), "credit_id")
    top = credits.withColumn("place", F.row_number().over(placed)).filter(F.col("place") <= most)
    everything = credits.groupBy("merchant_id").agg(F.sum("amount").alias("everything"))
    return top.join(everything, "merchant_id").join(proofs.select(*CREDIT, F.lit(True).alias("p")), CREDIT, "left").select(*CREDIT, "place", "amount", "value_date", F.coalesce("p", F.lit(False)).alias("proved"), F.round(F.col("amount") / F.col("everything"), 6).alias("share"))


def timing(rows: DataFrame) -> DataFrame:
    """How many calendar days payments took to settle, each lag's share, and the most common one."""
    lags = rows.filter("type = 'payment' AND settled_on IS NOT NULL").groupBy("merchant_id", F.datediff("settled_on", "created_on").alias("days")).agg(F.count(F.lit(1)).alias("payments"))
    whole = Window.partitionBy("merchant_id")
    usual = F.row_number().over(whole.orderBy(F.desc("payments"), "days")) == 1
    return lags.withColumn("share", F.round(F.col("payments") / F.sum("payments").over(whole), 6)).withColumn("usual", usual)


def merchant(profile: DataFrame) -> DataFrame:
    """The findings that hold, and those a person must settle."""
    return profile.filter("held IS NULL OR held").select("merchant_id", F.when(F.col("held").isNull(), F.concat("finding", F.lit("?"))).otherwise(F.col("finding")).alias("label"), "share")


def lookup(asked: DataFrame, lines: DataFrame, proofs: DataFrame, queue: DataFrame) -> DataFrame:
    """For each asked id (credit or settlement): its proof's lines, else its exception."""
    ids = proofs.select("merchant_id", "credit_id", F.explode(F.concat(F.array("credit_id"), F.col("settlement_ids"))).alias("asked"))
    hit = asked.join(ids, ["merchant_id", "asked"]).join(lines, CREDIT).select("merchant_id", "asked", "line_no", "label", "amount")
    miss = asked.join(ids, ["merchant_id", "asked"], "left_anti").join(queue.withColumnRenamed("subject_id", "asked"), ["merchant_id", "asked"])
    return hit.unionByName(miss.select("merchant_id", "asked", F.lit(0).alias("line_no"), F.col("code").alias("label"), "amount"))


def subjects(queue: DataFrame, credits: DataFrame, batches: DataFrame, payments: DataFrame) -> DataFrame:
    """Each exception joined to what it names: a credit, a settlement, a payment, or nothing known."""
    key = ["merchant_id", "subject_id"]
    c = credits.select("merchant_id", F.col("credit_id").alias("subject_id"), F.struct(F.lit("credit").alias("kind"), F.col("amount").alias("worth"), F.col("value_date").alias("occurred_on")).alias("c"))
    b = batches.select("merchant_id", F.col("settlement_id").alias("subject_id"), F.struct(F.lit("settlement").alias("kind"), F.col("expected_net").alias("worth"), F.col("settled_on").alias("occurred_on")).alias("b"))
    p = payments.select("merchant_id", F.col("payment_id").alias("subject_id"), F.struct(F.lit("payment").alias("kind"), F.col("amount").alias("worth"), F.col("captured_on").alias("occurred_on")).alias("p"))
    found = F.coalesce("c", "b", "p")
    j = queue.join(c, key, "left").join(b, key, "left").join(p, key, "left")
    return j.select("merchant_id", "code", "subject_id", "amount", F.coalesce(found["kind"], F.lit("unknown")).alias("kind"), found["worth"].alias("worth"), found["occurred_on"].alias("occurred_on"))
