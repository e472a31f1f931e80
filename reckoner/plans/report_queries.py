"""The standing report questions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causes, contract, reports
from ..operators import schedule as S
from ..sources.ledger import load
from .oracle import total
from .queries import _CLUSTERS, _LINES, _PROFILE, _clusters, _lines, _promised, _queue, _run, query

_TOP = "SELECT merchant_id, CAST(place AS INTEGER) AS place, label, amount FROM (SELECT merchant_id, subject_id AS label, amount, row_number() OVER (PARTITION BY merchant_id ORDER BY amount DESC, subject_id) AS place FROM queue WHERE {where}) WHERE place <= 12 UNION ALL SELECT merchant_id, 13, '... and ' || (count(*) - 12) || ' more cases', NULL FROM queue WHERE {where} GROUP BY merchant_id HAVING count(*) > 12"
_SHORT = "code IN ('FEE_DEDUCTION', 'TAX_DEDUCTION', 'PARTIAL_PAYMENT')"


@query(f"SELECT merchant_id, fee, tax, CASE WHEN held THEN gap ELSE 0 END AS withheld, gross, round(fee / gross, 6) AS fee_share FROM (SELECT merchant_id, {total('fee')} AS fee, {total('tax')} AS tax, {total("CASE WHEN type = 'payment' THEN amount END")} AS gross, {total("CASE WHEN type = 'payment' THEN amount - fee - tax - (credit - debit) END")} AS gap FROM settlement_rows GROUP BY merchant_id) JOIN held USING (merchant_id)")
def q1_charges(spark, d):
    rows = load(spark, d).rows
    return reports.charges(rows, contract.withholding(rows))


@query(f"SELECT merchant_id, count(*) FILTER (WHERE type = 'refund') AS refunds, {total("CASE WHEN type = 'refund' THEN amount END")} AS refunded, count(*) FILTER (WHERE type = 'adjustment') AS adjustments, {total("CASE WHEN type = 'adjustment' THEN amount END")} AS adjusted, {total('fee + tax')} AS cost FROM settlement_rows WHERE type IN ('refund', 'adjustment') GROUP BY merchant_id")
def q2_refunds(spark, d):
    return reports.refunds(load(spark, d).rows)


@query(f"SELECT b.merchant_id, b.value_date, count(*) AS credits, {total('b.amount')} AS amount, count(p.credit_id) AS proved FROM bank_credits b LEFT JOIN proofs p USING (merchant_id, credit_id) GROUP BY b.merchant_id, b.value_date")
def q3_received(spark, d):
    return reports.received(load(spark, d).credits, _run(spark, d).proofs)


@query(f"SELECT *, CAST(sum(net) OVER (PARTITION BY merchant_id ORDER BY due) AS BIGINT) AS through FROM (SELECT merchant_id, due, count(*) AS payments, {total('net')} AS net FROM promised WHERE NOT overdue GROUP BY merchant_id, due)")
def q4_landing(spark, d):
    return S.landings(_promised(spark, d)).select("merchant_id", "due", "payments", "net", "through")


@query(_CLUSTERS)
def q5_overcharge(spark, d):
    return _clusters(spark, d)


@query(_TOP.format(where=_SHORT))
def q6_shortfall(spark, d):
    return reports.by_size(_queue(spark, d), ["FEE_DEDUCTION", "TAX_DEDUCTION", "PARTIAL_PAYMENT"])


@query(_TOP.format(where="code = 'UNSETTLED_PAYMENT'"))
def q7_unsettled(spark, d):
    return reports.by_size(_queue(spark, d), ["UNSETTLED_PAYMENT"])


@query("SELECT merchant_id, place, cause AS label, members, total AS amount FROM causes_found UNION ALL SELECT merchant_id, 1000000, 'each their own', count(*), NULL FROM queue WHERE (merchant_id, code, subject_id) NOT IN (SELECT (merchant_id, code, subject_id) FROM caused) GROUP BY merchant_id")
def q8_unexplained(spark, d):
    queue = _queue(spark, d)
    return reports.unexplained(causes.induce(queue), causes.coverage(queue))


@query("SELECT merchant_id, cause AS what, members, total AS amount FROM causes_found WHERE place = 1 UNION ALL SELECT merchant_id, summary, 1, abs(amount) FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY abs(amount) DESC, subject_id DESC) AS nth FROM told ANTI JOIN causes_found USING (merchant_id)) WHERE nth = 1")
def q9_biggest(spark, d):
    queue = _queue(spark, d)
    return reports.biggest(causes.induce(queue), queue)


@query(f"SELECT merchant_id, method, {total('amount')} AS gross, {total('fee + tax')} AS cost, count(*) AS payments, round(CAST(sum(fee + tax) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS cost_share FROM settlement_rows WHERE type = 'payment' AND method IS NOT NULL GROUP BY merchant_id, method")
def q10_by_method(spark, d):
    return reports.by_method(load(spark, d).rows)


@query(f"SELECT merchant_id, value_date AS on_day, 'arrived' AS what, count(*) AS n, {total('amount')} AS amount FROM bank_credits GROUP BY ALL UNION ALL SELECT merchant_id, settled_on, 'payout runs', count(DISTINCT settlement_id), NULL FROM settlement_rows WHERE settled_on IS NOT NULL AND settlement_id IS NOT NULL GROUP BY merchant_id, settled_on UNION ALL SELECT merchant_id, captured_on, 'captured', count(*), {total('amount')} FROM payments GROUP BY merchant_id, captured_on")
def q11_on_a_day(spark, d):
    ledger = load(spark, d)
    return reports.on_days(ledger.credits, ledger.rows, ledger.payments)


@query(f"SELECT merchant_id, on_day, 'cases' AS what, count(*) AS n, {total('abs(amount)')} AS amount FROM (SELECT merchant_id, amount, unnest(days) AS on_day FROM told) GROUP BY merchant_id, on_day")
def q11_cases_by_day(spark, d):
    ledger = load(spark, d)
    return reports.on_days(ledger.credits, ledger.rows, ledger.payments, _queue(spark, d)).filter("what = 'cases'")


@query("SELECT merchant_id, CAST(days AS INTEGER) AS days, payments, round(payments / sum(payments) OVER (PARTITION BY merchant_id), 6) AS share, row_number() OVER (PARTITION BY merchant_id ORDER BY payments DESC, days) = 1 AS usual FROM (SELECT merchant_id, settled_on - created_on AS days, count(*) AS payments FROM settlement_rows WHERE type = 'payment' AND settled_on IS NOT NULL GROUP BY ALL)")
def q12_timing(spark, d):
    return reports.timing(load(spark, d).rows)


@query(f"SELECT merchant_id, CASE WHEN held IS NULL THEN finding || '?' ELSE finding END AS label, CASE WHEN \"of\" = 0 THEN 'no rows to read' ELSE rows || ' of ' || \"of\" END AS share FROM ({_PROFILE.replace('GROUP BY ALL', 'GROUP BY merchant_id')}) WHERE held IS NULL OR held")
def q13_merchant(spark, d):
    return reports.merchant(contract.profile(load(spark, d).rows))


_ASKED = "SELECT merchant_id, min(credit_id) AS asked FROM bank_credits GROUP BY merchant_id UNION SELECT merchant_id, max(settlement_id) FROM batches GROUP BY merchant_id"


@query(f"SELECT a.merchant_id, asked, line_no, label, l.amount FROM ({_ASKED}) a JOIN proofs p ON p.merchant_id = a.merchant_id AND (p.credit_id = asked OR list_contains(p.ids, asked)) JOIN ({_LINES}) l ON l.merchant_id = p.merchant_id AND l.credit_id = p.credit_id UNION ALL SELECT a.merchant_id, asked, 0, code, q.amount FROM ({_ASKED}) a JOIN queue q ON q.merchant_id = a.merchant_id AND q.subject_id = asked WHERE NOT EXISTS (SELECT 1 FROM proofs p WHERE p.merchant_id = a.merchant_id AND (p.credit_id = asked OR list_contains(p.ids, asked)))")
def q14_proof_lookup(spark, d):
    """Of each merchant the first credit and the last settlement are asked about."""
    run = _run(spark, d)
    asked = run.ledger.credits.groupBy("merchant_id").agg(F.min("credit_id").alias("asked")).union(run.batches.groupBy("merchant_id").agg(F.max("settlement_id").alias("asked"))).distinct()
    return reports.lookup(asked, _lines(spark, d), run.proofs, _queue(spark, d))


_LARGEST = "SELECT b.merchant_id, b.credit_id, CAST(place AS INTEGER) AS place, b.amount, b.value_date, p.credit_id IS NOT NULL AS proved, round(b.amount / everything, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY amount DESC, credit_id) AS place, sum(amount) OVER (PARTITION BY merchant_id) AS everything FROM bank_credits) b LEFT JOIN proofs p USING (merchant_id, credit_id) WHERE place <= 12"


@query(_LARGEST)
def q15_largest(spark, d):
    return reports.largest(load(spark, d).credits, _run(spark, d).proofs)


@query("SELECT q.merchant_id, code, subject_id, q.amount, CASE WHEN c.credit_id IS NOT NULL THEN 'credit' WHEN b.settlement_id IS NOT NULL THEN 'settlement' WHEN p.payment_id IS NOT NULL THEN 'payment' ELSE 'unknown' END AS kind, coalesce(c.amount, b.expected_net, p.amount) AS worth, coalesce(c.value_date, b.settled_on, p.captured_on) AS occurred_on FROM queue q LEFT JOIN bank_credits c ON c.merchant_id = q.merchant_id AND c.credit_id = subject_id LEFT JOIN batches b ON b.merchant_id = q.merchant_id AND b.settlement_id = subject_id LEFT JOIN payments p ON p.merchant_id = q.merchant_id AND p.payment_id = subject_id")
def q16_queue_subjects(spark, d):
    run = _run(spark, d)
    return reports.subjects(_queue(spark, d), run.ledger.credits, run.batches, run.ledger.payments)


@query(_LARGEST.replace("WHERE place <= 12", "WHERE place <= 5"))
def t1_largest_credits(spark, d):
    return reports.largest(load(spark, d).credits, _run(spark, d).proofs, 5)


@query(_TOP.format(where="true").replace("cases", "things"))
def t2_clipped_report(spark, d):
    queue = _queue(spark, d).withColumn("label", F.col("subject_id"))
    return reports.clip(queue, ["merchant_id"], [F.desc("amount"), "subject_id"], "things")
