"""Queries over a derived ledger, each with SQL for the same rows. Names follow the operator inventory."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, money, rates, text
from ..operators import batches as B
from ..operators import causes, contract, leaks, proofs, rungs, schedule, scoring, triage
from ..sources.ledger import load
from ..sources.session import cut, stamp
from .oracle import BAND, DUE, INR, PLAIN, PLATFORM, REFERENCE, SAID, STEM, days_after, days_between, outcome_after, rated, scored_after, total, with_ctes
from .reconcile import cascade, run_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF_BACK = 10


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_ctes(sql)
        return f

    return register


def _run(spark: SparkSession, d: str):
    """The run with all rungs."""
    return run_of(spark, d)


def _list(name: str):
    return F.array_join(name, ",").alias(name)


# ------------------------------------------------------------------ ledger and functions


@query("SELECT 'orders' AS kind, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM ledger_orders UNION ALL SELECT 'payments', count(*), CAST(sum(amount) AS BIGINT) FROM payments UNION ALL SELECT 'settlement_rows', count(*), CAST(sum(amount) AS BIGINT) FROM settlement_rows UNION ALL SELECT 'bank_credits', count(*), CAST(sum(amount) AS BIGINT) FROM bank_credits")
def s1_ledger(spark, d):
    ledger = load(spark, d)
    out = None
    for kind, df in (("orders", ledger.orders), ("payments", ledger.payments), ("settlement_rows", ledger.rows), ("bank_credits", ledger.credits)):
        part = df.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).select(F.lit(kind).alias("kind"), "n", "amount")
        out = part if out is None else out.unionByName(part)
    return out


_CREDIT_COLUMNS = ("merchant_id", "credit_id", "amount", "value_date", "narration", "utr")
_HASHED = " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in _CREDIT_COLUMNS)


@query(f"SELECT merchant_id, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5({_HASHED}), 1, 12)) AS BIGINT)) % {1 << 62} AS BIGINT) AS digest FROM bank_credits GROUP BY merchant_id")
def s3_fingerprint(spark, d):
    from ..sources.store import fingerprint

    return fingerprint(load(spark, d).credits, list(_CREDIT_COLUMNS), ["merchant_id"])


def _moved(ledger):
    """The ledger with its largest credits a paisa higher."""
    most = ledger.credits.agg(F.max("amount")).first()[0]
    credits = ledger.credits.withColumn("amount", F.col("amount") + F.when(F.col("amount") == most, 1).otherwise(0))
    return dataclasses.replace(ledger, credits=credits)


def _kept_run(spark, d) -> str:
    """The folder of a kept run of the plain cascade over the ledger before its largest credits were mended."""
    from ..sources.session import shared_dir
    from .reconcile import reconcile
    from .refresh import record

    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    record(reconcile(_moved(load(spark, d)), rungs.PLAIN_RUNGS), folder, rungs.PLAIN_RUNGS)
    return folder


@query("SELECT DISTINCT merchant_id FROM bank_credits WHERE amount = (SELECT max(amount) FROM bank_credits)")
def s3_changed_merchants(spark, d):
    """Whose tables differ from what a kept run read: here, those of the largest credits."""
    from .refresh import changed_merchants

    return changed_merchants(load(spark, d), _kept_run(spark, d), rungs.PLAIN_RUNGS)


@query(f"SELECT merchant_id, credit_id, strategy, verdict, array_to_string(ids, ',') AS settlement_ids, confidence, array_to_string(withdrawn, ',') AS withdrawn_ids, array_to_string(contested, ',') AS contested_by FROM ({outcome_after(len(PLAIN), 20)})")
def s3_refreshed_run(spark, d):
    """A kept run renewed for changed merchants alone: the outcomes of a full run."""
    from .refresh import refresh

    done = refresh(load(spark, d), _kept_run(spark, d), rungs.PLAIN_RUNGS)
    return done.select(*B.CREDIT, "strategy", "verdict", _list("settlement_ids"), "confidence", _list("withdrawn_ids"), _list("contested_by"))


@query("SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS paise, CAST(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) / 100 AS DECIMAL(22,2)) AS rupees FROM orders")
def f1_rupees(spark, d):
    paise = money.from_rupees(F.col("o_totalprice").cast("decimal(18,2)"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", paise.alias("paise"), money.to_rupees(paise).alias("rupees"))


@query(f"SELECT merchant_id, payment_id, {rated('amount', '0.0215')} AS corporate, {rated('amount', '0.03')} AS international FROM payments")
def f2_apply_rate(spark, d):
    return load(spark, d).payments.select("merchant_id", "payment_id", money.apply_rate(F.col("amount"), money.rate("0.0215")).alias("corporate"), money.apply_rate(F.col("amount"), money.rate("0.03")).alias("international"))


@query(f"SELECT merchant_id, entity_id, {INR('(credit - debit)')} AS shown FROM settlement_rows")
def f3_format_inr(spark, d):
    return load(spark, d).rows.select("merchant_id", "entity_id", money.format_inr(F.col("credit") - F.col("debit")).alias("shown"))


@query(f"SELECT merchant_id, credit_id, {REFERENCE} AS reference FROM bank_credits")
def f8_reference(spark, d):
    return load(spark, d).credits.select("merchant_id", "credit_id", text.extract_reference(F.col("narration")).alias("reference"))


@query(f"SELECT merchant_id, credit_id, {SAID} AS said FROM bank_credits")
def f9_narration_letters(spark, d):
    return load(spark, d).credits.select("merchant_id", "credit_id", text.narration_letters(F.col("narration")).alias("said"))


@query(f"SELECT merchant_id, credit_id, {STEM} AS stem FROM bank_credits")
def f10_payer_stem(spark, d):
    return load(spark, d).credits.select("merchant_id", "credit_id", text.payer_stem(F.col("narration")).alias("stem"))


@query(f"SELECT merchant_id, payment_id, {days_after('captured_on', 'amount % 9')} AS later, CASE WHEN isodow(captured_on) < 6 THEN captured_on ELSE {days_after('captured_on', '1')} END AS next_open, {days_between('captured_on', 'other')} AS between_days FROM (SELECT *, captured_on + CAST(amount % 41 AS INTEGER) - 20 AS other FROM payments)")
def f11_working_days(spark, d):
    day, other = F.col("captured_on"), F.date_add("captured_on", (F.col("amount") % 41).cast("int") - 20)
    return load(spark, d).payments.select("merchant_id", "payment_id", calendar.add_working_days(day, (F.col("amount") % 9).cast("int")).alias("later"), calendar.next_working_day(day).alias("next_open"), calendar.working_days_between(day, other).alias("between_days"))


@query(f"SELECT merchant_id, payment_id, {DUE} AS due FROM payments")
def f12_settlement_due(spark, d):
    return load(spark, d).payments.select("merchant_id", "payment_id", calendar.settlement_due(F.col("captured_on"), F.col("card_type")).alias("due"))


@query(f"SELECT merchant_id, payment_id, CAST({PLATFORM} AS DOUBLE) AS rate FROM payments JOIN rates USING (merchant_id)")
def f13_platform_rate(spark, d):
    p = load(spark, d).payments.join(contract.rate_cards(load(spark, d).rows), "merchant_id")
    return p.select("merchant_id", "payment_id", rates.platform_rate(F.col("method"), F.col("card_type"), F.col("standard"), F.col("corporate_card"), F.col("international_card")).cast("double").alias("rate"))


@query(f"SELECT merchant_id, payment_id, fee, tax, tds, amount - fee - tax - tds AS net FROM (SELECT *, {rated('fee', 'gst')} AS tax FROM (SELECT merchant_id, payment_id, amount, gst, {rated('amount', PLATFORM)} AS fee, CASE WHEN tds_applies THEN {rated('amount', 'r.tds')} ELSE 0 END AS tds FROM payments JOIN rates r USING (merchant_id)))")
def f14_deductions(spark, d):
    p = load(spark, d).payments.join(contract.rate_cards(load(spark, d).rows), "merchant_id")
    contracted = rates.platform_rate(F.col("method"), F.col("card_type"), F.col("standard"), F.col("corporate_card"), F.col("international_card"))
    parts = rates.deductions(F.col("amount"), contracted, F.col("gst"), F.col("tds"), F.col("tds_applies"))
    return p.select("merchant_id", "payment_id", *[v.alias(k) for k, v in parts.items()])


@query(f"SELECT merchant_id, entity_id, CAST(CASE WHEN amount <= 100000 THEN 799 WHEN amount <= 2500000 THEN 1199 ELSE 1499 END AS BIGINT) AS refund_fee, {rated('amount', '0.001')} AS route_fee FROM settlement_rows WHERE type <> 'payment'")
def f15_flat_fees(spark, d):
    r = load(spark, d).rows.filter("type <> 'payment'")
    return r.select("merchant_id", "entity_id", rates.instant_refund_fee(F.col("amount")).alias("refund_fee"), money.apply_rate(F.col("amount"), money.rate("0.001")).alias("route_fee"))


@query("SELECT merchant_id, entity_id, credit - debit AS signed_net, amount - fee - tax - credit AS deduction FROM settlement_rows")
def f16_signed_net(spark, d):
    return load(spark, d).rows.select("merchant_id", "entity_id", money.signed_net(F.col("credit"), F.col("debit")).alias("signed_net"), money.implied_deduction(F.col("amount"), F.col("fee"), F.col("tax"), F.col("credit")).alias("deduction"))


@query("SELECT merchant_id, entity_id, CAST(CAST(round(CAST(fee AS DECIMAL(28,8)) / CAST(amount AS DECIMAL(20,0)), 4) AS DECIMAL(6,4)) AS DOUBLE) AS rate FROM settlement_rows WHERE amount <> 0")
def f17_implied_rate(spark, d):
    return load(spark, d).rows.filter("amount <> 0").select("merchant_id", "entity_id", money.implied_rate(F.col("fee"), F.col("amount")).cast("double").alias("rate"))


@query(f"SELECT merchant_id, {BAND} AS band, count(*) AS rows FROM settlement_rows WHERE type = 'payment' GROUP BY ALL")
def f18_rate_band(spark, d):
    return load(spark, d).rows.filter("type = 'payment'").groupBy("merchant_id", rates.rate_band(F.col("method"), F.col("card_type")).alias("band")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT merchant_id, CAST(greatest(standard, corporate_card, international_card) * (1 + gst) + CASE WHEN tds_applies THEN tds ELSE 0 END AS DOUBLE) AS band FROM rates")
def f19_widest_deduction(spark, d):
    return contract.rate_cards(load(spark, d).rows).select("merchant_id", rates.widest_deduction().cast("double").alias("band"))


# ------------------------------------------------------------------ aggregations


@query("SELECT merchant_id, settlement_id, settlement_utr, settled_on, rows, payments, gross, fee, tax, debit_fee, debit_tax, debits, refund_principal, pay_credit, expected_net, allowance FROM batches")
def a1_batches(spark, d):
    return B.rebuild(load(spark, d).rows).select("merchant_id", "settlement_id", "settlement_utr", "settled_on", *B.MEASURES)


@query(f"SELECT x.merchant_id, x.credit_id, array_to_string(list_sort(list(settlement_id)), ',') AS settlement_ids, count(*) AS members, min(settled_on) AS opened_on, max(settled_on) AS settled_on, {total('expected_net')} AS expected_net, {total('allowance')} AS allowance, {total('gross')} AS gross FROM truth_links x JOIN batches USING (merchant_id, settlement_id) GROUP BY x.merchant_id, x.credit_id")
def a2_batch_groups(spark, d):
    ledger = load(spark, d)
    claims = ledger.truth_links.groupBy(*B.CREDIT).agg(F.collect_list("settlement_id").alias("settlement_ids"))
    return B.group_claims(claims, B.rebuild(ledger.rows)).select(*B.CREDIT, _list("settlement_ids"), "members", "opened_on", "settled_on", "expected_net", "allowance", "gross")


@query("SELECT merchant_id, entity_id, type, debit, on_hold FROM settlement_rows WHERE settlement_id IS NULL")
def a3_pending(spark, d):
    return B.pending(load(spark, d).rows).select("merchant_id", "entity_id", "type", "debit", "on_hold")


@query("SELECT merchant_id, held, CASE WHEN paid < 12 THEN 0 ELSE exact END AS rows, paid AS \"of\" FROM held")
def a4_withholding(spark, d):
    return contract.withholding(load(spark, d).rows).drop("finding")


_PROFILE = """SELECT merchant_id, 'Section 194-O withholding' AS finding, held, CASE WHEN paid < 12 THEN 0 ELSE exact END AS rows, paid AS "of" FROM held
UNION ALL SELECT merchant_id, 'Route transfers', count(*) FILTER (WHERE type = 'transfer') > 0, count(*) FILTER (WHERE type = 'transfer'), count(*) FROM settlement_rows GROUP BY ALL
UNION ALL SELECT merchant_id, 'Instant settlement', count(*) FILTER (WHERE type = 'payment' AND created_on = settled_on) > 0, count(*) FILTER (WHERE type = 'payment' AND created_on = settled_on), count(*) FILTER (WHERE type = 'payment' AND settled_on IS NOT NULL) FROM settlement_rows GROUP BY merchant_id"""


@query(_PROFILE.split("UNION ALL", 1)[1].replace("SELECT merchant_id, 'Route transfers', count(*) FILTER (WHERE type = 'transfer') > 0, count(*) FILTER (WHERE type = 'transfer'), count(*)", "SELECT merchant_id, 'Route transfers' AS finding, count(*) FILTER (WHERE type = 'transfer') > 0 AS held, count(*) FILTER (WHERE type = 'transfer') AS rows, count(*) AS \"of\"").replace("GROUP BY ALL", "GROUP BY merchant_id"))
def a5_route_and_instant(spark, d):
    return contract.route_and_instant(load(spark, d).rows)


@query(f"SELECT *, CASE WHEN \"of\" = 0 THEN 'no rows to read' ELSE rows || ' of ' || \"of\" END AS share FROM ({_PROFILE.replace('GROUP BY ALL', 'GROUP BY merchant_id')})")
def a6_profile(spark, d):
    return contract.profile(load(spark, d).rows)


@query("SELECT merchant_id, band, CAST(rate AS DOUBLE) AS rate, rows, \"of\" FROM induced WHERE band <> 'gst'")
def a7_induce_platform(spark, d):
    return contract.induce_platform(load(spark, d).rows).withColumn("rate", F.col("rate").cast("double"))


@query("SELECT merchant_id, CAST(rate AS DOUBLE) AS rate, rows, \"of\" FROM induced WHERE band = 'gst'")
def a8_induce_gst(spark, d):
    return contract.induce_gst(load(spark, d).rows).drop("band").withColumn("rate", F.col("rate").cast("double"))


@query("SELECT merchant_id, CAST(standard AS DOUBLE) AS standard, CAST(corporate_card AS DOUBLE) AS corporate_card, CAST(international_card AS DOUBLE) AS international_card, CAST(gst AS DOUBLE) AS gst, tds_applies FROM rates")
def a9_rate_card(spark, d):
    c = contract.rate_cards(load(spark, d).rows)
    return c.select("merchant_id", *[F.col(x).cast("double").alias(x) for x in ("standard", "corporate_card", "international_card", "gst")], "tds_applies")


def _leaks(spark, d):
    return leaks.charged_above_contract(load(spark, d).rows, contract.rate_cards(load(spark, d).rows))


_CLUSTERS = f"""SELECT merchant_id, CAST(contracted_rate AS DOUBLE) AS contracted_rate, CAST(charged_rate AS DOUBLE) AS charged_rate, method, card_type, payments, overcharge, gst, gross_affected, first_seen, last_seen, networks, payment_ids
FROM (SELECT merchant_id, contracted_rate, CAST(round_even(CAST(fee AS DECIMAL(28,8)) / amount, 4) AS DECIMAL(6,4)) AS charged_rate, method, card_type, count(*) AS payments, {total('overcharge')} AS overcharge, {total('gst_on_overcharge')} AS gst, {total('amount')} AS gross_affected,
             min(settled_on) AS first_seen, max(settled_on) AS last_seen, array_to_string(list_sort(list(coalesce(payment_id, entity_id))), ',') AS payment_ids FROM leaks GROUP BY ALL)
LEFT JOIN (SELECT merchant_id, contracted_rate, charged_rate, method, card_type, array_to_string(list(card_network ORDER BY n DESC, card_network), ',') AS networks
           FROM (SELECT merchant_id, contracted_rate, CAST(round_even(CAST(fee AS DECIMAL(28,8)) / amount, 4) AS DECIMAL(6,4)) AS charged_rate, method, card_type, card_network, count(*) AS n FROM leaks WHERE card_network IS NOT NULL GROUP BY ALL) GROUP BY ALL) USING (merchant_id, contracted_rate, charged_rate, method, card_type)"""


def _clusters(spark, d):
    c = leaks.clusters(_leaks(spark, d), None)
    return c.select("merchant_id", F.col("contracted_rate").cast("double").alias("contracted_rate"), F.col("charged_rate").cast("double").alias("charged_rate"), "method", "card_type", "payments", "overcharge", "gst", "gross_affected", "first_seen", "last_seen", _list("networks"), _list("payment_ids"))


@query(_CLUSTERS)
def a10_leak_clusters(spark, d):
    return _clusters(spark, d)


@query("SELECT merchant_id, coalesce(payment_id, entity_id) AS payment_id, CAST(contracted_rate AS DOUBLE) AS contracted_rate, CAST(CAST(round_even(CAST(fee AS DECIMAL(28,8)) / amount, 4) AS DECIMAL(6,4)) AS DOUBLE) AS charged_rate, method, card_type FROM leaks")
def a10_cluster_members(spark, d):
    """Every leak with the cluster it belongs to."""
    return _leaks(spark, d).select("merchant_id", "payment_id", *[F.col(c).cast("double").alias(c) for c in ("contracted_rate", "charged_rate")], "method", "card_type")


@query(f"SELECT merchant_id, rows_examined, coalesce(payments, 0) AS payments, coalesce(overcharge, 0) AS overcharge, coalesce(gst, 0) AS gst, coalesce(overcharge, 0) + coalesce(gst, 0) AS cash_impact FROM (SELECT merchant_id, count(*) FILTER (WHERE type = 'payment') AS rows_examined FROM settlement_rows GROUP BY merchant_id) LEFT JOIN (SELECT merchant_id, count(*) AS payments, {total('overcharge')} AS overcharge, {total('gst_on_overcharge')} AS gst FROM leaks GROUP BY merchant_id) USING (merchant_id)")
def a11_leak_totals(spark, d):
    return leaks.totals(_leaks(spark, d), load(spark, d).rows)


@query("SELECT merchant_id, complete_to FROM complete")
def a12_report_complete_to(spark, d):
    return B.report_complete_to(load(spark, d).rows)


# ------------------------------------------------------------------ joins and matching


def _attempt(spark, d, rung):
    run = _run(spark, d)
    return rung(run.ledger.credits, run.batches, run.rates).select(*B.CREDIT, "strategy", "verdict", _list("settlement_ids"), _list("candidates"), "confidence")


def _attempt_sql(name: str) -> str:
    """A rung over all credits and all batches, whatever other rungs did: a chain of its own."""
    from .oracle import CTES, FULL, _rung

    i = 90 + FULL.index(name)
    CTES.update({f"u{i}": "SELECT * FROM bank_credits", f"a{i}": "SELECT * FROM batches"} | _rung(i, name))
    return with_ctes(f"SELECT merchant_id, credit_id, strategy, verdict, array_to_string(ids, ',') AS settlement_ids, array_to_string(candidates, ',') AS candidates, confidence FROM t{i}")


def _rung_query(name: str, rung, of: str):
    def f(spark, d):
        return _attempt(spark, d, rung)

    f.__name__ = name
    QUERIES[name] = f
    ORACLE_SQL[name] = _attempt_sql(of)


_rung_query("j1_exact_reference", rungs.exact_reference, "exact")
_rung_query("j2_amount_and_date", rungs.amount_and_date, "amount")
_rung_query("j3_subset_sum", rungs.subset_sum, "subset")
_rung_query("j4_fuzzy_narration", rungs.fuzzy_narration, "fuzzy")
_rung_query("j5_shortfall", rungs.shortfall, "short")


@query("SELECT merchant_id, credit_id, verdict, array_to_string(ids, ',') AS settlement_ids, array_to_string(withdrawn, ',') AS withdrawn_ids FROM w0")
def j6_proof_veto(spark, d):
    from ..operators.claims import veto

    run = _run(spark, d)
    return veto(rungs.exact_reference(run.ledger.credits, run.batches), run.ledger.credits, run.batches).select(*B.CREDIT, "verdict", _list("settlement_ids"), _list("withdrawn_ids"))


_EVERY_NEAR = "SELECT c.merchant_id, c.credit_id, b.settlement_id FROM bank_credits c JOIN batches b ON b.merchant_id = c.merchant_id AND b.settled_on BETWEEN c.value_date - 1 AND c.value_date + 1 AND abs(amount - expected_net) <= allowance"


@query(f"WITH n AS ({_EVERY_NEAR}), o AS (SELECT merchant_id, credit_id, min(settlement_id) AS s FROM n GROUP BY ALL), c AS (SELECT merchant_id, s, list_sort(list(credit_id)) AS claimants FROM o GROUP BY ALL) SELECT merchant_id, credit_id, CASE WHEN len(claimants) > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS verdict, CASE WHEN len(claimants) > 1 THEN array_to_string(list_filter(claimants, lambda x: x <> credit_id), ',') ELSE '' END AS contested_by FROM o JOIN c USING (merchant_id, s)".replace("WITH n AS", "SELECT * FROM (WITH n AS") + ")")
def j7_contested(spark, d):
    """Claims of the lowest payout each credit fits by amount and day, so that some are contested."""
    from ..operators.claims import demote_contested

    run = _run(spark, d)
    fits = rungs.amount_and_date(run.ledger.credits, run.batches).filter("size(candidates) > 0")
    claims = fits.withColumn("verdict", F.lit("MATCHED")).withColumn("settlement_ids", F.slice("candidates", 1, 1)).withColumn("withdrawn_ids", F.array().cast("array<string>"))
    return demote_contested(claims).select(*B.CREDIT, "verdict", _list("contested_by"))


@query("SELECT merchant_id, credit_id, strategy, verdict, array_to_string(withdrawn, ',') AS withdrawn_ids FROM o1")
def j8_outcome_fold(spark, d):
    from ..operators import claims as C

    ledger = load(spark, d)
    credits, batches = ledger.credits, cut(B.rebuild(ledger.rows))
    first = cut(C.demote_contested(C.veto(rungs.exact_reference(credits, batches), credits, batches)))
    open_ = credits.join(first.filter("verdict <> 'MATCHED'").select(*B.CREDIT), B.CREDIT, "left_semi")
    claimed = first.filter("verdict = 'MATCHED'").select("merchant_id", F.explode("settlement_ids").alias("settlement_id"))
    second = C.veto(rungs.amount_and_date(open_, batches.join(claimed, B.KEY, "left_anti")), open_, batches)
    return C.fold(first.filter("verdict <> 'MATCHED'"), C.demote_contested(second)).select(*B.CREDIT, "strategy", "verdict", _list("withdrawn_ids"))


_COLUMNS = "merchant_id, credit_id, strategy, verdict, array_to_string(ids, ',') AS settlement_ids, confidence, array_to_string(withdrawn, ',') AS withdrawn_ids, array_to_string(contested, ',') AS contested_by"


def _outcome(run):
    return run.outcome.select(*B.CREDIT, "strategy", "verdict", _list("settlement_ids"), "confidence", _list("withdrawn_ids"), _list("contested_by"))


@query(f"SELECT {_COLUMNS} FROM outcome")
def j9_cascade(spark, d):
    return _outcome(_run(spark, d))


@query(f"SELECT {_COLUMNS} FROM ({outcome_after(len(PLAIN), 20)})")
def j9_cascade_plain(spark, d):
    """The cascade without the similarity of damaged references."""
    return _outcome(run_of(spark, d, rungs.PLAIN_RUNGS))


@query(f"SELECT {_COLUMNS} FROM ({outcome_after(len(PLAIN), 40)})")
def j9_cascade_anchored(spark, d):
    """The plain cascade with rungs that are told the outcome so far."""
    ledger, run = load(spark, d), _run(spark, d)
    done = cascade(ledger.credits, run.batches, run.rates, rungs.PLAIN_RUNGS, anchored=True)
    return done.select(*B.CREDIT, "strategy", "verdict", _list("settlement_ids"), "confidence", _list("withdrawn_ids"), _list("contested_by"))


@query("SELECT merchant_id, credit_id, verdict, array_to_string(ids, ',') AS settlement_ids, array_to_string(candidates, ',') AS candidates, confidence FROM t42")
def j3_anchored_sums(spark, d):
    """Sums over what two rungs left, each credit's withdrawn claim a part of the answer."""
    run = _run(spark, d)
    credits = run.ledger.credits
    prior = cascade(credits, run.batches, run.rates, (rungs.exact_reference, rungs.amount_and_date))
    left = prior.filter("verdict <> 'MATCHED'")
    claimed = prior.filter("verdict = 'MATCHED'").select("merchant_id", F.explode("settlement_ids").alias("settlement_id"))
    sums = rungs.subset_sum(credits.join(left.select(*B.CREDIT), B.CREDIT, "left_semi"), run.batches.join(claimed, B.KEY, "left_anti"), run.rates, left)
    return sums.select(*B.CREDIT, "verdict", _list("settlement_ids"), _list("candidates"), "confidence")


@query(f"SELECT {_COLUMNS} FROM outcome")
def s2_saved_and_reconciled(spark, d):
    """The four tables saved, read again as given ones and reconciled: the same outcomes."""
    from ..sources.ledger import read
    from ..sources.session import shared_dir
    from ..sources.store import save_ledger
    from .reconcile import reconcile

    folder = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    save_ledger(load(spark, d), folder)
    return _outcome(reconcile(read(spark, folder)))


def _refs(cond: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(entity_id) FILTER (WHERE {cond})), ','), '')"


def _line(no: int, label: str, amount: str, refs: str, when: str) -> str:
    return f"SELECT merchant_id, credit_id, {no} AS line_no, {label} AS label, CAST({amount} AS BIGINT) AS amount, {refs} AS refs FROM g WHERE {when}"


_G = f"""SELECT x.merchant_id, x.credit_id, any_value(x.amount) AS credited, any_value(x.residual) AS gap, any_value(x.allowance) AS allowance, any_value(gst) AS gst, count(DISTINCT r.settlement_id) AS members,
 count(*) FILTER (WHERE type = 'payment') AS n1, {total("CASE WHEN type = 'payment' THEN r.amount ELSE 0 END")} AS a1, {_refs("type = 'payment'")} AS r1,
 {total("CASE WHEN type = 'payment' THEN r.fee ELSE 0 END")} AS a2, {_refs("type = 'payment' AND r.fee <> 0")} AS r2,
 {total("CASE WHEN type = 'payment' THEN r.tax ELSE 0 END")} AS a3, {_refs("type = 'payment' AND r.tax <> 0")} AS r3,
 {total("CASE WHEN type = 'payment' THEN r.amount - r.fee - r.tax - credit ELSE 0 END")} AS a4, {_refs("type = 'payment' AND r.amount - r.fee - r.tax - credit <> 0")} AS r4,
 bool_and(type <> 'payment' OR r.amount - r.fee - r.tax - credit = 0 OR r.amount - r.fee - r.tax - credit = {rated('r.amount', '0.01')}) AS statutory,
 {", ".join(f"count(*) FILTER (WHERE type = '{k}') AS n{i}, {total(f"CASE WHEN type = '{k}' THEN debit - r.fee - r.tax ELSE 0 END")} AS a{i}, {_refs(f"type = '{k}'")} AS r{i}" for i, k in ((5, "refund"), (6, "adjustment"), (7, "transfer")))},
 {", ".join(f"count(*) FILTER (WHERE {c}) AS n{i}, {total(f'CASE WHEN {c} THEN r.fee + r.tax ELSE 0 END')} AS a{i}, {_refs(c)} AS r{i}" for i, c in ((8, "type IN ('refund', 'adjustment') AND (r.fee <> 0 OR r.tax <> 0)"), (9, "type = 'transfer' AND (r.fee <> 0 OR r.tax <> 0)")))}
FROM (SELECT *, unnest(ids) AS settlement_id FROM tried WHERE matched AND proved) x JOIN settlement_rows r USING (merchant_id, settlement_id) JOIN rates USING (merchant_id) GROUP BY x.merchant_id, x.credit_id"""
_LINES = f"SELECT * FROM (WITH g AS ({_G}) " + " UNION ALL ".join(
    [
        _line(1, "'Settled payments (' || n1 || ')' || CASE WHEN members > 1 THEN ' across ' || members || ' settlements' ELSE '' END", "a1", "r1", "true"),
        _line(2, "'Platform fee'", "-a2", "r2", "a2 <> 0"),
        _line(3, "'GST on platform fee @' || CAST(CAST(gst * 100 AS INTEGER) AS VARCHAR) || '%'", "-a3", "r3", "a3 <> 0"),
        _line(4, "CASE WHEN statutory THEN 'TDS under Section 194-O @1%' ELSE 'Unattributed per-transaction deduction' END", "-a4", "r4", "r4 <> ''"),
        _line(5, "'Refunds recovered (' || n5 || ')'", "-a5", "r5", "n5 > 0"),
        _line(6, "'Chargebacks and adjustments (' || n6 || ')'", "-a6", "r6", "n6 > 0"),
        _line(7, "'Routed to linked accounts (' || n7 || ')'", "-a7", "r7", "n7 > 0"),
        _line(8, "'Instant refund charges (' || n8 || '), incl. GST'", "-a8", "r8", "n8 > 0"),
        _line(9, "'Route commission @0.1% (' || n9 || '), incl. GST'", "-a9", "r9", "n9 > 0"),
        _line(10, "'Rounding drift (per-transaction fee vs batch-level GST)'", "gap", "r3", "gap <> 0 AND abs(gap) <= allowance"),
    ]
) + ")"


def _lines(spark, d):
    run = _run(spark, d)
    return proofs.proof_lines(run.proofs, run.ledger.credits, run.ledger.rows, run.batches, run.rates)


@query(_LINES)
def j10_proof_lines(spark, d):
    return _lines(spark, d).select(*B.CREDIT, "line_no", "label", "amount", _list("refs"))


@query("SELECT merchant_id, credit_id, array_to_string(ids, ',') AS settlement_ids, residual, strategy FROM shorts")
def j11_shortfalls(spark, d):
    return _run(spark, d).shortfalls.select(*B.CREDIT, _list("settlement_ids"), "residual", "strategy")


@query("SELECT merchant_id, settlement_id, CASE WHEN claimed_by IS NULL THEN expected_net ELSE 0 END AS amount, claimed_by, that_day AS batches_that_day FROM missing WHERE NOT found")
def j12_missing_settlements(spark, d):
    run = _run(spark, d)
    return proofs.missing_settlements(run.batches, run.proofs, run.outcome).select("merchant_id", "settlement_id", F.col("amount").cast("long").alias("amount"), "claimed_by", "batches_that_day")


@query("SELECT merchant_id, payment_id, amount, due, complete_to FROM unsettled")
def j13_unsettled_payments(spark, d):
    ledger = load(spark, d)
    return triage.unsettled_payments(ledger.payments, ledger.rows).select("merchant_id", "payment_id", "amount", "due", "complete_to")


@query("SELECT merchant_id, credit_id, 'exact' AS fit, entity, debit, home AS recovered_by FROM refund_exact UNION ALL SELECT merchant_id, credit_id, 'near', entity, debit, home FROM refund_near")
def j14_recovery_gaps(spark, d):
    run = _run(spark, d)
    out = None
    for fit, exact in (("exact", True), ("near", False)):
        part = triage.recovery_gaps(run.shortfalls, run.ledger.rows, exact).select(*B.CREDIT, F.lit(fit).alias("fit"), "entity", F.col("entity_amount").alias("debit"), "recovered_by")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT merchant_id, credit_id, CAST(place AS INTEGER) AS place, entity_id, away FROM (SELECT s.merchant_id, s.credit_id, r.entity_id, abs(r.debit - abs(s.residual)) AS away, row_number() OVER (PARTITION BY s.merchant_id, s.credit_id ORDER BY abs(r.debit - abs(s.residual)), r.entity_id) AS place FROM shorts s JOIN settlement_rows r ON r.merchant_id = s.merchant_id AND r.type IN ('refund', 'adjustment') WHERE r.settlement_id IS NULL OR NOT list_contains(s.ids, r.settlement_id)) WHERE place <= 12")
def j15_nearest_refunds(spark, d):
    run = _run(spark, d)
    return triage.nearest_refunds(run.shortfalls, run.ledger.rows).select(*B.CREDIT, "place", "entity_id", "away")


@query("SELECT merchant_id, coalesce(payment_id, entity_id) AS payment_id, fee AS charged_fee, contracted_fee, overcharge, gst_on_overcharge FROM leaks")
def j16_leaks(spark, d):
    return _leaks(spark, d).select("merchant_id", "payment_id", "charged_fee", "contracted_fee", "overcharge", "gst_on_overcharge")


# ------------------------------------------------------------------ triage and causes


def _queue(spark, d, run=None):
    key = (spark.sparkContext.applicationId, *stamp(spark, f"{d}/orders.parquet"), run is None)
    if key not in _queues:
        _queues[key] = cut(triage.exceptions(run or _run(spark, d)))
    return _queues[key]


_queues: dict = {}


@query("SELECT merchant_id, credit_id, code, entity FROM (SELECT merchant_id, credit_id, code, CASE WHEN code = 'PARTIAL_PAYMENT' THEN entity END AS entity FROM named)")
def c1_named_shortfalls(spark, d):
    run = _run(spark, d)
    return triage.name_shortfalls(run.shortfalls, run.ledger.rows, run.rates).select(*B.CREDIT, "code", F.col("refund.entity").alias("entity"))


@query("SELECT merchant_id, credit_id, CAST(slab AS DOUBLE) AS slab FROM named WHERE slab IS NOT NULL")
def c2_gst_slab(spark, d):
    run = _run(spark, d)
    return triage.name_shortfalls(run.shortfalls, run.ledger.rows, run.rates).filter("slab IS NOT NULL").select(*B.CREDIT, F.col("slab").cast("double").alias("slab"))


@query("SELECT merchant_id, credit_id, round(share, 6) AS share FROM named WHERE share IS NOT NULL")
def c3_hidden_fee(spark, d):
    run = _run(spark, d)
    return triage.name_shortfalls(run.shortfalls, run.ledger.rows, run.rates).filter("share IS NOT NULL").select(*B.CREDIT, F.round(F.col("share").cast("double"), 6).alias("share"))


@query("SELECT merchant_id, subject_id, amount, reason, settlement FROM queue WHERE reason IS NOT NULL")
def c4_unmatched(spark, d):
    q = _queue(spark, d).filter("element_at(evidence, 'reason') IS NOT NULL")
    return q.select("merchant_id", "subject_id", "amount", F.element_at("evidence", "reason").alias("reason"), F.element_at("evidence", "settlement").alias("settlement"))


@query("SELECT merchant_id, code, subject_id, amount FROM queue WHERE code IN ('MISSING_SETTLEMENT', 'UNSETTLED_PAYMENT')")
def c5_absences(spark, d):
    run = _run(spark, d)
    return triage.absences(run).select("merchant_id", "code", "subject_id", "amount")


@query("SELECT merchant_id, code, subject_id, amount FROM queue")
def c6_exception_queue(spark, d):
    return _queue(spark, d).select("merchant_id", "code", "subject_id", "amount")


def _rule_sql(no: int, key: str, where: str, source: str = "queue", having: str = "count(*) >= 2") -> str:
    return f"SELECT merchant_id, {no} AS rule_no, CAST({key} AS VARCHAR) AS cause_key, count(*) AS members, {total('abs(amount)')} AS total, array_to_string(list_sort(list(subject_id)), ',') AS member_ids FROM {source} WHERE {where} GROUP BY merchant_id, {key} HAVING {having}"


_RULES = [
    ("c7_counted_twice", _rule_sql(1, "key", "code = 'MISSING_SETTLEMENT' AND subject_id IN (SELECT unnest(string_split(settlements, ', ')) FROM queue z WHERE z.merchant_id = y.merchant_id AND settlements IS NOT NULL)", "(SELECT *, 'named' AS key FROM queue) y")),
    ("c8_undisclosed_rate", _rule_sql(2, "rate_bucket", "code = 'FEE_DEDUCTION'")),
    ("c9_tax_rate", _rule_sql(3, "rate_applied", "code = 'TAX_DEDUCTION'")),
    ("c10_whole_run_missing", _rule_sql(4, "settled_on", "code = 'MISSING_SETTLEMENT'", having="count(*) >= 2 AND min(that_day) = count(*) AND max(that_day) = count(*)")),
    ("c11_one_settlement_several_credits", _rule_sql(5, "settlement", "reason = 'contested settlement'")),
    ("c12_one_payer", _rule_sql(6, "stem", "true", "their_stems")),
    ("c13_refunds_elsewhere", _rule_sql(7, "key", "code = 'PARTIAL_PAYMENT'", "(SELECT *, 'all' AS key FROM queue)")),
    ("c14_never_arrived", _rule_sql(8, "key", "code = 'MISSING_SETTLEMENT'", "(SELECT *, 'all' AS key FROM queue)")),
    ("c15_never_reported", _rule_sql(9, "key", "code = 'UNSETTLED_PAYMENT'", "(SELECT *, 'all' AS key FROM queue)")),
]


def _rule_query(name: str, no: int, sql: str):
    def f(spark, d):
        return causes.one_rule(_queue(spark, d), no, None).select("merchant_id", "rule_no", "cause_key", "members", "total", _list("member_ids"))

    f.__name__ = name
    QUERIES[name] = f
    ORACLE_SQL[name] = with_ctes(sql)


for _no, (_rule, _sql) in enumerate(_RULES):
    _rule_query(_rule, _no, _sql)


@query("SELECT merchant_id, place, cause, cause_key, members, total, codes, member_ids FROM causes_found")
def c16_causes(spark, d):
    return causes.induce(_queue(spark, d), None).select("merchant_id", "place", "cause", "cause_key", "members", "total", "codes", _list("member_ids"))


@query("SELECT merchant_id, rule_no, cause_key, code, subject_id, amount FROM caused")
def c16_cause_members(spark, d):
    """Every exception with the cause it belongs to."""
    return causes.members(causes.assign(_queue(spark, d)))


@query(f"SELECT m.merchant_id, credited, coalesce(proved, 0) AS proved, coalesce(awaited, 0) AS awaited FROM (SELECT merchant_id, {total('amount')} AS credited FROM bank_credits GROUP BY ALL) m LEFT JOIN (SELECT merchant_id, {total('amount')} AS proved FROM proofs GROUP BY ALL) p USING (merchant_id) LEFT JOIN (SELECT merchant_id, {total('amount')} AS awaited FROM queue WHERE code IN ('MISSING_SETTLEMENT', 'UNSETTLED_PAYMENT') GROUP BY ALL) w USING (merchant_id)")
def a13_cash_position(spark, d):
    from ..operators.reports import cash_position

    run = _run(spark, d)
    return cash_position(run.ledger.credits, run.proofs, _queue(spark, d))


@query(f"SELECT merchant_id, code AS item, count(*) AS n, {total('amount')} AS amount FROM queue GROUP BY ALL UNION ALL SELECT merchant_id, 'proofs', count(*), {total('drift')} FROM proofs GROUP BY merchant_id UNION ALL SELECT merchant_id, 'proofs with drift', count(*), {total('abs(drift)')} FROM proofs WHERE drift <> 0 GROUP BY merchant_id")
def a14_run_summary(spark, d):
    from ..operators.reports import run_summary

    return run_summary(_run(spark, d).proofs, _queue(spark, d))


# ------------------------------------------------------------------ windows, sorts, sets


@query(f"SELECT merchant_id, due, {total('sum(net)')} OVER (PARTITION BY merchant_id ORDER BY due) AS through FROM promised WHERE NOT overdue GROUP BY merchant_id, due".replace("CAST(coalesce(sum(sum(net)), 0) AS BIGINT) OVER (PARTITION BY merchant_id ORDER BY due)", "CAST(sum(sum(net)) OVER (PARTITION BY merchant_id ORDER BY due) AS BIGINT)"))
def w1_running_landings(spark, d):
    return schedule.landings(_promised(spark, d)).select("merchant_id", "due", "through")


@query("SELECT merchant_id, band, CAST(candidate AS DOUBLE) AS rate, CAST(n AS BIGINT) AS \"of\" FROM modal WHERE band <> 'gst'")
def w5_modal_rate(spark, d):
    spread = contract.rate_spread(load(spark, d).rows, 10_000)
    total_ = F.sum("votes").over(Window.partitionBy("merchant_id", "band"))
    return spread.withColumn("of", total_).filter("place = 1").select("merchant_id", "band", F.col("rate").cast("double").alias("rate"), "of")


@query(f"SELECT merchant_id, credit_id, line_no, amount, CAST(sum(amount) OVER (PARTITION BY merchant_id, credit_id ORDER BY line_no) AS BIGINT) AS running FROM ({_LINES})")
def w6_running_proof(spark, d):
    return proofs.running_balance(_lines(spark, d)).select(*B.CREDIT, "line_no", "amount", "running")


@query("SELECT merchant_id, credit_id, settlement_id, score, second FROM scored93 WHERE place = 1")
def w4_fuzzy_margin(spark, d):
    run = _run(spark, d)
    return rungs.fuzzy_scores(run.ledger.credits, run.batches).select(*B.CREDIT, "settlement_id", "score", "second")


@query("SELECT merchant_id, payment_id FROM (SELECT merchant_id, entity_id AS payment_id FROM settlement_rows UNION SELECT merchant_id, payment_id FROM settlement_rows WHERE payment_id IS NOT NULL)")
def u1_reported_ids(spark, d):
    return proofs.reported_ids(load(spark, d).rows)


@query("SELECT p.merchant_id, p.credit_id, p.ids = coalesce(expected, []) AS same, len(list_filter(p.ids, lambda x: NOT list_contains(coalesce(expected, []), x))) = 0 AS within FROM tried p LEFT JOIN credit_score s USING (merchant_id, credit_id) WHERE p.matched".replace("p.ids = coalesce(expected, [])", "coalesce(p.ids = expected, false)"))
def u2_set_equality(spark, d):
    run = _run(spark, d)
    return scoring.set_relation(run.outcome.filter("verdict = 'MATCHED'"), run.ledger.truth_links).select(*B.CREDIT, "same", "within")


# ------------------------------------------------------------------ forward schedule


def _as_of(spark, d):
    return schedule.as_of_days(load(spark, d).payments, AS_OF_BACK)


def _promised(spark, d):
    ledger = load(spark, d)
    return schedule.commitments(ledger.payments, ledger.rows, contract.rate_cards(ledger.rows), _as_of(spark, d))


@query("SELECT merchant_id, as_of FROM as_of")
def k1_as_of(spark, d):
    return _as_of(spark, d)


@query("SELECT merchant_id, entity_id AS payment_id FROM settlement_rows JOIN as_of USING (merchant_id) WHERE type = 'payment' AND settled_on <= as_of UNION SELECT merchant_id, payment_id FROM settlement_rows JOIN as_of USING (merchant_id) WHERE type = 'payment' AND settled_on <= as_of AND payment_id IS NOT NULL")
def k2_settled_ids(spark, d):
    return schedule.settled_ids(load(spark, d).rows, _as_of(spark, d))


@query("SELECT merchant_id, payment_id, routed FROM routed")
def k3_routed(spark, d):
    return schedule.routed_by(load(spark, d).rows, _as_of(spark, d))


@query("SELECT merchant_id, payment_id, as_of, captured_on, due, cycle_days, gross, routed, net, overdue FROM promised")
def k4_commitments(spark, d):
    return _promised(spark, d)


_LANDINGS = f"SELECT merchant_id, due, count(*) AS payments, {total('gross')} AS gross, {total('gross - net - routed')} AS deducted, {total('routed')} AS routed, {total('net')} AS net FROM promised WHERE NOT overdue GROUP BY merchant_id, due"


@query(_LANDINGS)
def k5_landings(spark, d):
    return schedule.landings(_promised(spark, d)).drop("through")


@query("SELECT merchant_id, entity_id AS subject_id, type AS kind, credit - debit AS amount, CASE WHEN on_hold THEN 'on hold at the gateway' WHEN type = 'refund' THEN 'netted out of the next payout large enough' WHEN type = 'adjustment' THEN 'recovered from a payout not named yet' ELSE 'reported without a settlement date' END AS because FROM settlement_rows JOIN as_of USING (merchant_id) WHERE created_on <= as_of AND settled_on IS NULL AND credit <> debit")
def k6_undated(spark, d):
    return schedule.undated(load(spark, d).rows, _as_of(spark, d))


@query("SELECT merchant_id, payment_id, due, predicted, landed_on, actual, days_out, error FROM landed")
def k7_grade(spark, d):
    return schedule.grade(_promised(spark, d), load(spark, d).rows)


@query(f"SELECT merchant_id, count(*) AS checked, count(landed_on) AS arrived, count(*) FILTER (WHERE days_out = 0) / count(*) AS on_the_day, count(*) FILTER (WHERE abs(days_out) <= 1) / count(*) AS within_a_day, CASE WHEN sum(predicted) > 0 THEN CAST({total('CASE WHEN days_out = 0 THEN predicted ELSE 0 END')} AS DOUBLE) / {total('predicted')} ELSE 0.0 END AS money_on_the_day, coalesce(count(*) FILTER (WHERE landed_on IS NOT NULL AND error = 0) / nullif(count(landed_on), 0), 0.0) AS to_the_paisa, {total('CASE WHEN landed_on IS NULL THEN predicted ELSE 0 END')} AS missing, {total('CASE WHEN landed_on IS NOT NULL THEN error ELSE 0 END')} AS error_on_arrivals FROM landed GROUP BY merchant_id")
def k8_accuracy(spark, d):
    return schedule.accuracy(schedule.grade(_promised(spark, d), load(spark, d).rows))


# ------------------------------------------------------------------ scoring


def _graded(spark, d):
    return _graded_run(_run(spark, d))


def _graded_run(run):
    """Only shortfalls are exceptions that name a credit; the queue's other parts explain none, or are about payouts and payments."""
    named = triage.shortfall_exceptions(triage.name_shortfalls(run.shortfalls, run.ledger.rows, run.rates))
    return scoring.graded_credits(run.ledger.truth, run.ledger.truth_links, run.proofs, run.shortfalls, named)


_CARD = """count(*) AS credits, count(*) FILTER (WHERE matchable AND provable) AS matchable, count(*) FILTER (WHERE NOT matchable) AS impossible, count(*) FILTER (WHERE claimed AND "right") AS true_positives, count(*) FILTER (WHERE claimed AND NOT "right") AS false_positives,
count(*) FILTER (WHERE matchable AND provable AND NOT claimed) AS false_negatives, count(*) FILTER (WHERE NOT matchable AND NOT claimed) AS correct_refusals, count(*) FILTER (WHERE matchable AND attributed) AS attributed,
count(*) FILTER (WHERE matchable AND NOT provable) AS unprovable, count(*) FILTER (WHERE matchable AND NOT provable AND named) AS unprovable_named, count(*) FILTER (WHERE members > 1) AS merged, count(*) FILTER (WHERE claimed AND "right" AND members > 1) AS merged_resolved,
count(*) FILTER (WHERE claimed AND drift <> 0) AS proofs_with_drift, CAST(coalesce(sum(drift), 0) AS BIGINT) AS drift_net, CAST(coalesce(sum(abs(drift)), 0) AS BIGINT) AS drift_gross"""


@query(f"SELECT merchant_id, {_CARD} FROM credit_score GROUP BY merchant_id")
def e1_scorecard(spark, d):
    return scoring.scorecard(_graded(spark, d), ["merchant_id"])


@query("SELECT merchant_id, credit_id, attributed FROM credit_score")
def e2_attribution(spark, d):
    return _graded(spark, d).select(*B.CREDIT, "attributed")


@query("SELECT defect, count(*) FILTER (WHERE matchable AND provable AND NOT claimed) AS unresolved, count(*) FILTER (WHERE matchable AND NOT provable AND NOT named) AS unexplained FROM credit_score GROUP BY defect")
def e3_by_defect(spark, d):
    return scoring.by_defect(_graded(spark, d))


@query("SELECT merchant_id, expected, found, false_leaks, CASE WHEN expected > 0 THEN found / expected ELSE 0.0 END AS recall, CASE WHEN found + false_leaks > 0 THEN found / (found + false_leaks) ELSE 0.0 END AS precision FROM (SELECT merchant_id, count(t.payment_id) AS expected, count(*) FILTER (WHERE t.payment_id IS NOT NULL AND l.payment_id IS NOT NULL) AS found, count(*) FILTER (WHERE t.payment_id IS NULL) AS false_leaks FROM (SELECT DISTINCT merchant_id, coalesce(payment_id, entity_id) AS payment_id, 1 AS x FROM leaks) l FULL JOIN (SELECT merchant_id, payment_id FROM leak_truth) t USING (merchant_id, payment_id) GROUP BY merchant_id)")
def e4_leak_score(spark, d):
    return scoring.leak_score(_leaks(spark, d), load(spark, d).leak_truth)


_RATES = ", ".join(f"CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0.0 END AS {n}" for a, b, n in (("true_positives", "matchable", "match_rate"), ("true_positives", "true_positives + false_positives", "precision"), ("correct_refusals", "impossible", "refusal_rate"), ("attributed", "matchable + unprovable", "attribution_rate"), ("unprovable_named", "unprovable", "explained_rate"), ("merged_resolved", "merged", "merged_rate")))


@query(f"SELECT *, {_RATES} FROM (SELECT {_CARD} FROM credit_score)")
def e5_rates(spark, d):
    return scoring.rates(scoring.scorecard(_graded(spark, d)))


@query(" UNION ALL ".join(scored_after(n, f"SELECT {n} AS rungs, '{rung.__name__}' AS last_rung, *, {_RATES} FROM (SELECT {_CARD} FROM credit_score)") for n, rung in enumerate(rungs.RUNGS, 1)))
def e6_ablation(spark, d):
    """One rung more for each row, made and kept one after the other: five runs' grading in one plan fills the driver."""
    from .reconcile import ablation

    out = None
    for n, run in enumerate(ablation(run_of(spark, d)), 1):
        card = scoring.rates(scoring.scorecard(_graded_run(run))).select(F.lit(n).alias("rungs"), F.lit(rungs.RUNGS[n - 1].__name__).alias("last_rung"), "*")
        card = cut(card)
        out = card if out is None else out.unionByName(card)
    return out


_POOL = f"SELECT merchant_id, {_CARD} FROM credit_score GROUP BY merchant_id"
_PAIRS = " UNION ALL ".join(f"SELECT merchant_id, '{n}' AS measure, {a} AS hit, {b} AS total FROM s" for n, a, b in (("match rate", "true_positives", "matchable"), ("refusal rate", "correct_refusals", "impossible"), ("shortfalls named", "unprovable_named", "unprovable"), ("merged credits resolved", "merged_resolved", "merged")))
_SPREAD = "CAST(sum(hit) AS BIGINT) AS numerator, CAST(sum(total) AS BIGINT) AS denominator, coalesce(min(r), 0.0) AS lowest, coalesce(median(r), 0.0) AS middle, coalesce(max(r), 0.0) AS highest, CASE WHEN sum(total) > 0 THEN CAST(sum(hit) AS BIGINT) / CAST(sum(total) AS BIGINT) ELSE 0.0 END AS pooled"


def _measures(spark, d):
    card = scoring.scorecard(_graded(spark, d), ["merchant_id"])
    pair = lambda n, a, b: F.struct(F.lit(n).alias("measure"), F.col(a).alias("hit"), F.col(b).alias("total"))
    pairs = F.array(pair("match rate", "true_positives", "matchable"), pair("refusal rate", "correct_refusals", "impossible"), pair("shortfalls named", "unprovable_named", "unprovable"), pair("merged credits resolved", "merged_resolved", "merged"))
    return card.select("merchant_id", F.explode(pairs).alias("p")).select("merchant_id", "p.*")


@query(f"SELECT * FROM (WITH s AS ({_POOL}), p AS (SELECT *, CASE WHEN total <> 0 THEN hit / total END AS r FROM ({_PAIRS})) SELECT measure, {_SPREAD} FROM p GROUP BY measure)")
def e7_pooled(spark, d):
    return scoring.pool(_measures(spark, d), ["measure"])


@query(f"SELECT * FROM (WITH s AS ({_POOL}), p AS (SELECT *, merchant_id % 4 AS tier, CASE WHEN total <> 0 THEN hit / total END AS r FROM ({_PAIRS})) SELECT measure, tier, {_SPREAD} FROM p GROUP BY measure, tier)")
def e8_curve(spark, d):
    """Pooled measures by tier; merchants fall into four tiers by their id."""
    return scoring.pool(_measures(spark, d).withColumn("tier", F.col("merchant_id") % 4), ["measure", "tier"])


@query(f"SELECT merchant_id, count(*) AS claims, count(*) FILTER (WHERE abs(amount - explained) <= allowance) AS proved FROM (SELECT x.merchant_id, x.credit_id, any_value(c.amount) AS amount, {total('pay_credit - debits')} AS explained, {total('b.allowance')} AS allowance FROM truth_links x JOIN credit_truth t ON t.merchant_id = x.merchant_id AND t.credit_id = x.credit_id AND t.matchable JOIN bank_credits c ON c.merchant_id = x.merchant_id AND c.credit_id = x.credit_id JOIN batches b ON b.merchant_id = x.merchant_id AND b.settlement_id = x.settlement_id GROUP BY x.merchant_id, x.credit_id) GROUP BY merchant_id")
def e9_oracle_ceiling(spark, d):
    run = _run(spark, d)
    claims = scoring.truth_claims(run.ledger.truth, run.ledger.truth_links, run.batches)
    return proofs.prove(claims, run.ledger.credits, run.batches).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("proved").alias("proved"))
