"""Naming what would not reconcile, by arithmetic alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import settlement_due
from ..functions.money import format_inr
from ..sources.session import merged
from .batches import CREDIT, report_complete_to
from .proofs import missing_settlements, reported_ids

#: India's GST slabs.
SLABS = ("0.05", "0.12", "0.18", "0.28")
LEAST_FEE, MOST_FEE = "0.0005", "0.01"
BIN, SLICES = 256, 10  # debits in a bin about; slices of money are a 2^SLICES-th of a power of two wide


def recovery_gaps(shortfalls: DataFrame, rows: DataFrame, exact: bool) -> DataFrame:
    """Shortfalls that equal the debit of just one refund or adjustment outside their payouts.

    Exact: to the paisa, an equi-join. Else within the allowance: the difference is
    spread over whole paise, so that it is an equi-join as well.
    """
    short = shortfalls.filter("residual < 0").select(*CREDIT, "settlement_ids", "allowance", (-F.col("residual")).alias("short"))
    debits = rows.filter("type IN ('refund', 'adjustment')").select("merchant_id", "entity_id", "type", "debit", "settlement_id", "created_on")
    wanted = F.array("short") if exact else F.sequence(F.col("short") - F.col("allowance"), F.col("short") + F.col("allowance"))
    fits = merged(short.withColumn("debit", F.explode(wanted))).join(debits, ["merchant_id", "debit"])
    fits = fits.filter("settlement_id IS NULL OR NOT array_contains(settlement_ids, settlement_id)")
    one = fits.groupBy(*CREDIT).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("entity_id", "type", "debit", "settlement_id", "created_on")).alias("row"))
    return one.filter("n = 1").select(*CREDIT, F.col("row.entity_id").alias("entity"), F.col("row.type").alias("entity_type"), F.col("row.debit").alias("entity_amount"), F.coalesce("row.settlement_id", F.lit("no batch yet")).alias("recovered_by"), F.col("row.created_on").alias("raised_on"))


def nearest_refunds(shortfalls: DataFrame, rows: DataFrame, most: int = 12) -> DataFrame:
    """The `most` refunds and adjustments outside a shortfall's payouts that come nearest to it, equals by id.

    Debits are cut into bins of about BIN rows by merchant and money, and each
    shortfall meets the bins around it, twice as many in each round, until `most` of
    what it met is nearer than anything beyond, or nothing is left. So neither a
    merchant nor a frame bounds what it sees, and no task holds more than bins.
    """
    from ..sources.session import cut

    debits = rows.filter("type IN ('refund', 'adjustment')").select("merchant_id", F.col("debit").alias("money"), "entity_id", "settlement_id")
    bounds = Window.partitionBy("merchant_id").orderBy("slice")
    # Slices of 2^k paise around each power of two: their counts, then bins of whole slices.
    size = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col("money"), F.lit(1)))) - SLICES)
    debits = debits.withColumn("slice", F.expr(f"shiftright(money, cast(greatest(0, floor(log2(greatest(money, 1))) - {SLICES}) as int))") + size.cast("long") * (1 << (SLICES + 1)))
    slices = debits.groupBy("merchant_id", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("money").alias("low"), F.max("money").alias("high"))
    upto = F.sum("n").over(bounds.rowsBetween(Window.unboundedPreceding, -1))
    bins = slices.withColumn("bin", F.floor(F.coalesce(upto, F.lit(0)) / BIN))
    binned = cut(debits.join(bins.select("merchant_id", "slice", "bin"), ["merchant_id", "slice"]).select("merchant_id", "bin", "money", "entity_id", "settlement_id"))
    spans = cut(bins.groupBy("merchant_id", "bin").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("no", F.row_number().over(Window.partitionBy("merchant_id").orderBy("bin"))))
    asks = shortfalls.select(*CREDIT, "settlement_ids", F.abs("residual").alias("short"))
    # The last bin that begins at or below the shortfall: bins and shortfalls of a merchant in one order by money.
    begins = spans.select("merchant_id", F.lit(None).cast("string").alias("credit_id"), F.lit(None).cast("array<string>").alias("settlement_ids"), F.col("low").alias("short"), "no")
    both = begins.unionByName(asks.withColumn("no", F.lit(None).cast("int")))
    upto_here = Window.partitionBy("merchant_id").orderBy("short", F.col("no").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    home = both.withColumn("at", F.coalesce(F.max("no").over(upto_here), F.lit(1))).filter("credit_id IS NOT NULL").drop("no")
    left, reach, found = cut(home.join(spans.groupBy("merchant_id").agg(F.max("no").alias("last")), "merchant_id")), 1, None
    place = Window.partitionBy(*CREDIT).orderBy("away", "entity_id")
    while True:
        near = left.withColumn("no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - reach), F.least(F.col("last"), F.col("at") + reach)))).join(spans, ["merchant_id", "no"])
        fits = near.join(binned, ["merchant_id", "bin"]).filter("settlement_id IS NULL OR NOT array_contains(settlement_ids, settlement_id)").withColumn("away", F.abs(F.col("money") - F.col("short")))
        best = cut(fits.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).select(*CREDIT, "short", "entity_id", F.col("money").alias("debit"), "away", "place"))
        # What lies beyond is at least as far as the edges of what was met.
        edges = near.groupBy(*CREDIT, "short", "at", "last").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        sure = F.least(F.when(F.col("at") - reach > 1, F.col("short") - F.col("low")).otherwise(F.lit(2**62)), F.when(F.col("at") + reach < F.col("last"), F.col("high") - F.col("short")).otherwise(F.lit(2**62)))
        whole = (F.col("at") - reach <= 1) & (F.col("at") + reach >= F.col("last"))
        done = cut(
            edges.join(best.groupBy(*CREDIT).agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("far")), CREDIT, "left")
            .filter(whole | ((F.col("n") >= most) & (F.col("far") < sure)))
            .select(*CREDIT)
        )
        part = best.join(done, CREDIT, "left_semi")
        found = part if found is None else found.unionByName(part)
        left = cut(left.join(done, CREDIT, "left_anti"))
        if not left.take(1):
            return found
        reach *= 2


def tax_slab(shortfalls_with_rates: DataFrame) -> Column:
    """The statutory slab that a shortfall's tax would come to, if it is one and not the contract's."""
    applied = (F.col("tax") - F.col("residual")).cast("decimal(28,8)") / F.col("fee").cast("decimal(20,0)")
    out = F.lit(None).cast("decimal(3,2)")
    for slab in reversed(SLABS):
        out = F.when(F.abs(applied - F.lit(slab).cast("decimal(3,2)")) <= F.lit("0.005").cast("decimal(4,3)"), F.lit(slab).cast("decimal(3,2)")).otherwise(out)
    return F.when((F.col("residual") < 0) & (F.col("fee") != 0) & (out != F.col("gst")), out)


def hidden_fee_base() -> Column:
    """A shortfall with the tax on it taken off, half even."""
    return F.rint(-F.col("residual") / (1 + F.col("gst").cast("double"))).cast("long")


def name_shortfalls(shortfalls: DataFrame, rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Each shortfall with its code: exact refund, GST slab, near refund, fee share, else unexplained. What is too much stays unexplained."""
    exact = recovery_gaps(shortfalls, rows, True).select(*CREDIT, F.struct("entity", "entity_type", "entity_amount", "recovered_by", "raised_on").alias("exact"))
    near = recovery_gaps(shortfalls, rows, False).select(*CREDIT, F.struct("entity", "entity_type", "entity_amount", "recovered_by", "raised_on").alias("near"))
    s = shortfalls.join(rates.select("merchant_id", "gst"), "merchant_id").join(exact, CREDIT, "left").join(near, CREDIT, "left")
    base = hidden_fee_base()
    share = base.cast("decimal(28,8)") / F.col("gross").cast("decimal(20,0)")
    bounds = [F.lit(x).cast("decimal(5,4)") for x in (LEAST_FEE, MOST_FEE)]
    fee_like = (F.col("residual") < 0) & (F.col("gross") != 0) & share.between(*bounds)
    s = s.withColumn("slab", tax_slab(s)).withColumn("base", base).withColumn("share", F.when(fee_like, share))
    code = F.when(F.col("exact").isNotNull(), "PARTIAL_PAYMENT").when(F.col("slab").isNotNull(), "TAX_DEDUCTION").when(F.col("near").isNotNull(), "PARTIAL_PAYMENT").when(F.col("share").isNotNull(), "FEE_DEDUCTION").otherwise("UNEXPLAINED")
    return s.withColumn("code", code).withColumn("refund", F.when(F.col("code") == "PARTIAL_PAYMENT", F.coalesce("exact", "near")))


def _evidence(*pairs) -> Column:
    """A map of the pairs whose value is not null."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs]), lambda e: e["v"].isNotNull())
    return F.map_from_entries(entries)


def _words(strategy: Column) -> Column:
    return F.regexp_replace(strategy, "_", " ")


def _listed(ids: Column) -> Column:
    return F.array_join(ids, ", ")


def shortfall_exceptions(named: DataFrame) -> DataFrame:
    code, short = F.col("code"), F.abs("residual")
    is_ = lambda *c: code.isin(*c)
    when = lambda cond, v: F.when(cond, v)
    percent = F.concat(F.format_number((F.bround(F.col("share"), 5) * 100).cast("double"), 3), F.lit("%"))
    slab = F.concat((F.col("slab") * 100).cast("int").cast("string"), F.lit("%"))
    drift = short - F.col("refund.entity_amount")
    evidence = _evidence(
        ("settlements", _listed(F.col("settlement_ids"))),
        ("identified_by", _words(F.col("strategy"))),
        ("recovered_by", F.col("refund.recovered_by")),
        ("entity", F.col("refund.entity")),
        ("entity_amount", format_inr(F.col("refund.entity_amount"))),
        ("rounding_drift", format_inr(drift)),
        ("raised_on", F.col("refund.raised_on")),
        ("tax_reported", when(is_("TAX_DEDUCTION"), format_inr(F.col("tax")))),
        ("tax_implied", when(is_("TAX_DEDUCTION"), format_inr(F.col("tax") + short))),
        ("rate_applied", when(is_("TAX_DEDUCTION"), slab)),
        ("fee_reported", when(is_("FEE_DEDUCTION"), format_inr(F.col("fee")))),
        ("extra_charged", when(is_("FEE_DEDUCTION"), format_inr(F.col("base")))),
        ("implied_rate", when(is_("FEE_DEDUCTION"), percent)),
        ("residual", when(is_("UNEXPLAINED"), format_inr(F.col("residual")))),
        ("rows", when(is_("UNEXPLAINED", "FEE_DEDUCTION"), F.when(is_("UNEXPLAINED"), F.col("rows")).otherwise(F.col("payments")))),
    )
    summary = (
        F.when(is_("PARTIAL_PAYMENT"), F.concat(F.lit("Short by "), format_inr(short), F.lit(", which is "), F.when(drift == 0, "").otherwise(F.concat(format_inr(F.abs(drift)), F.when(drift > 0, " more than ").otherwise(" less than "))), F.col("refund.entity_type"), F.lit(" "), F.col("refund.entity"), F.lit(", recovered from "), F.col("refund.recovered_by")))
        .when(is_("TAX_DEDUCTION"), F.concat(F.lit("GST came off at "), slab, F.lit("; the difference is "), format_inr(short)))
        .when(is_("FEE_DEDUCTION"), F.concat(F.lit("Short by "), format_inr(short), F.lit(": an extra "), percent, F.lit(" of gross and GST on it, not in the report")))
        .otherwise(F.concat(format_inr(short), F.lit(" of this credit is not explained by its rows")))
    )
    return named.select("merchant_id", "code", F.col("credit_id").alias("subject_id"), short.alias("amount"), summary.alias("summary"), evidence.alias("evidence"))


def unmatched_exceptions(outcome: DataFrame, shortfalls: DataFrame, credits: DataFrame, batches: DataFrame) -> DataFrame:
    """Credits that nothing claims: none fits, several fit, or several credits fit one payout."""
    that_day = batches.groupBy("merchant_id", F.col("settled_on").alias("value_date")).agg(F.count(F.lit(1)).alias("that_day"))
    rest = outcome.filter("verdict <> 'MATCHED'").join(shortfalls.select(*CREDIT), CREDIT, "left_anti")
    r = rest.join(credits.select(*CREDIT, "amount", "value_date", "narration"), CREDIT).join(that_day, ["merchant_id", "value_date"], "left")
    ambiguous, contested = F.col("verdict") == "AMBIGUOUS", F.size("contested_by") > 0
    reason = F.when(ambiguous & contested, "contested settlement").when(ambiguous, "ambiguous").otherwise("no candidate")
    evidence = _evidence(
        ("reason", reason),
        ("narration", F.col("narration")),
        ("settlements_that_day", F.when(~ambiguous, F.coalesce("that_day", F.lit(0)))),
        ("settlement", F.when(ambiguous & contested, F.get("candidates", F.lit(0)))),
        ("also claimed by", F.when(ambiguous & contested, _listed(F.col("contested_by")))),
        ("candidates", F.when(ambiguous & ~contested, _listed(F.col("candidates")))),
        ("strategy", F.when(ambiguous, F.col("strategy"))),
    )
    summary = (
        F.when(ambiguous & contested, F.concat(format_inr(F.col("amount")), F.lit(" and other credits fit one settlement")))
        .when(ambiguous, F.concat(format_inr(F.col("amount")), F.lit(" fits "), F.size("candidates").cast("string"), F.lit(" settlements equally well")))
        .otherwise(F.concat(format_inr(F.col("amount")), F.lit(" arrived with no settlement behind it")))
    )
    return r.select("merchant_id", F.lit("UNEXPLAINED").alias("code"), F.col("credit_id").alias("subject_id"), "amount", summary.alias("summary"), evidence.alias("evidence"))


def missing_exceptions(batches: DataFrame, proofs: DataFrame, outcome: DataFrame) -> DataFrame:
    m = missing_settlements(batches, proofs, outcome)
    evidence = _evidence(("settled_on", F.col("settled_on")), ("rows", F.col("rows")), ("reference", F.coalesce("settlement_utr", F.lit("absent"))), ("batches_that_day", F.col("batches_that_day")), ("claimed_by", F.col("claimed_by")))
    summary = F.concat(F.lit("The gateway reported "), format_inr(F.col("expected_net")), F.when(F.col("claimed_by").isNull(), "; no bank credit matches it").otherwise(F.concat(F.lit("; "), F.col("claimed_by"), F.lit(" came up short against it"))))
    return m.select("merchant_id", F.lit("MISSING_SETTLEMENT").alias("code"), F.col("settlement_id").alias("subject_id"), F.col("amount").cast("long").alias("amount"), summary.alias("summary"), evidence.alias("evidence"))


def unsettled_payments(payments: DataFrame, rows: DataFrame) -> DataFrame:
    """Captured payments that no row names although they were due within the report."""
    due = payments.withColumn("due", settlement_due(F.col("captured_on"), F.col("card_type")))
    late = due.join(report_complete_to(rows), "merchant_id").filter("due <= complete_to")
    return late.join(reported_ids(rows), ["merchant_id", "payment_id"], "left_anti")


def unsettled_exceptions(payments: DataFrame, rows: DataFrame) -> DataFrame:
    u = unsettled_payments(payments, rows)
    evidence = _evidence(("captured_on", F.col("captured_on")), ("method", F.col("method")), ("order", F.col("order_id")), ("report_complete_to", F.col("complete_to")))
    summary = F.concat(format_inr(F.col("amount")), F.lit(" was captured and appears nowhere in the report"))
    return u.select("merchant_id", F.lit("UNSETTLED_PAYMENT").alias("code"), F.col("payment_id").alias("subject_id"), "amount", summary.alias("summary"), evidence.alias("evidence"))


def absences(run) -> DataFrame:
    """The part of a run's queue that names what has not come: payouts and captured payments."""
    return missing_exceptions(run.batches, run.proofs, run.outcome).unionByName(unsettled_exceptions(run.ledger.payments, run.ledger.rows))


def exceptions(run) -> DataFrame:
    """The whole queue of a run."""
    named = name_shortfalls(run.shortfalls, run.ledger.rows, run.rates)
    return (
        shortfall_exceptions(named)
        .unionByName(unmatched_exceptions(run.outcome, run.shortfalls, run.ledger.credits, run.batches))
        .unionByName(absences(run))
    )
