"""From text files to a run."""

import datetime as dt

import pytest
from reckoner.operators.rungs import PLAIN_RUNGS
from reckoner.plans.importing import import_folder
from reckoner.plans.reconcile import reconcile

D = dt.date(2026, 7, 20)
REPORT = "entity_id,type,amount,credit,debit,fee,tax,created_at,settlement_id,settled_at,settlement_utr,payment_id,order_id,method"


def report(name, n, first, show):
    lines = [REPORT]
    for k in range(first, first + n):
        day = show(D + dt.timedelta(k % 9))
        lines.append(f"pay_{k},Sale,{1000 + k}.00,{1000 + k - 23.6:.2f},0,20.00,3.60,{day},setl_{k},{day},UTR0000000{k:05d},pay_{k},o_{k},upi")
    return {name: "\n".join(lines)}


def paid(k):
    return f"{1000 + k - 23.6:.2f}"


@pytest.fixture(scope="module")
def made(spark):
    iso, slash = lambda d: d.isoformat(), lambda d: d.strftime("%d/%m/%Y")
    one = ["ACME Bank", "", "Posting Date,Particulars,Deposit Amt,Withdrawal Amt"]
    one += [f'{slash(D + dt.timedelta(k % 9))},"NEFT UTR0000000{k:05d}' + ("\nsecond line" if k % 4 == 0 else "") + f'","{paid(k)} Cr",' for k in range(20)]
    two = ["Value Date,Narration,Credit,Debit"]
    two += [f"{(D + dt.timedelta(k % 9)).strftime('%d-%b-%Y')},IMPS x,{paid(k)}," for k in range(20, 40)] + ["22-Jul-2026,rent,,500.00", "x,broken,5.00,"]
    vague = ["Value Date,Narration,Credit,Debit"] + [f"0{1 + k % 3}/0{1 + k % 4}/2026,NEFT UTR0000000{k:05d},5," for k in range(12)]
    files = {"a1": "\n".join(one), "a2": "\n".join(two), "b": "only,a\n1,2", "c1": "\n".join(vague)}
    files |= report("a3", 20, 0, iso) | report("a4", 20, 20, slash) | report("c2", 20, 60, iso)
    lines = [(f, n, t) for f, text in files.items() for n, t in enumerate(text.split("\n"), 1)]
    owner = spark.createDataFrame([(f, {"a": 1, "b": 2, "c": 3}[f[0]]) for f in files], "file string, merchant_id long")
    return import_folder(spark.createDataFrame(lines, "file string, line long, text string"), owner)


def test_two_banks_and_two_gateways_are_one_run(made):
    counts = {(r.merchant_id, r.kind): (r.kept, r.dropped) for r in made.counts.collect()}
    assert counts[1, "settlement_rows"] == (40, 0) and counts[1, "bank_credits"] == (41, 1)  # the withdrawal is read, too
    patterns = {(r.file, r.field): r.pattern for r in made.plan.filter("temporal").collect()}
    assert patterns["a1", "value_date"] == "d/M/yyyy" and patterns["a2", "value_date"] == "d-MMM-yyyy" and patterns["a4", "settled_at"] == "d/M/yyyy"
    ids = sorted(r.credit_id for r in made.ledger.credits.filter("merchant_id = 1").collect())
    assert ids == [f"bank_{k:05d}" for k in range(1, 41)]
    outcome = {r.credit_id: (r.verdict, r.settlement_ids) for r in reconcile(made.ledger, PLAIN_RUNGS).outcome.filter("merchant_id = 1").collect()}
    assert outcome == {f"bank_{k + 1:05d}": ("MATCHED", [f"setl_{k}"]) for k in range(40)}


def test_limitations_stand_beside(made):
    limits = {(r.merchant_id, r.file, r.kind, r.field, r.state, r.blocking) for r in made.limitations.collect()}
    assert (2, None, "bank_credits", None, "missing kind", True) in limits and (2, None, "orders", None, "missing kind", False) in limits
    assert (1, None, "orders", None, "missing kind", False) in limits and not any(r[0] == 1 and r[5] for r in limits)
    assert any(r[:2] == (3, "c1") and r[4] == "no certain date pattern" for r in limits)
    assert {r.merchant_id for r in made.ledger.rows.select("merchant_id").distinct().collect()} == {1, 3}


def test_answers_come_first(spark):
    text = "\n".join([REPORT.replace("created_at", "When").replace("settled_at", "Date")] + report("x", 15, 0, lambda d: d.isoformat())["x"].split("\n")[1:])
    bank = "\n".join(["Date,Narration,Credit"] + [f"2026-07-{k + 10},x,{paid(k)}" for k in range(15)])
    lines = spark.createDataFrame([(f, n, t) for f, x in (("r", text), ("k", bank)) for n, t in enumerate(x.split("\n"), 1)], "file string, line long, text string")
    files = spark.createDataFrame([("r", 1), ("k", 1)], "file string, merchant_id long")
    assert import_folder(lines, files).ledger.rows.count() == 0
    answers = spark.createDataFrame([("r", "settlement_rows", "created_at", "When"), ("r", "settlement_rows", "settled_at", "Date")], "file string, kind string, field string, col string")
    done = import_folder(lines, files, answers)
    assert not done.limitations.filter("blocking").collect() and done.ledger.rows.filter("settled_on IS NOT NULL").count() == 15
