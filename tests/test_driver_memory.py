"""Tables that grow with the input are not sent whole to the driver because their files are small."""

import re

import pytest
from pyspark.sql import functions as F
from reckoner.operators import claims, rungs, scoring
from reckoner.operators import profiling as P
from reckoner.operators.batches import group_claims
from reckoner.operators.proofs import prove
from reckoner.operators.triage import recovery_gaps
from reckoner.plans import reconcile as R
from reckoner.plans.registry import QUERIES
from reckoner.sources.session import cut, merged


def _broadcast(df):
    """The nodes that the driver would gather, each with the join keys it is for."""
    return re.findall(r"BroadcastHashJoin \[[^\]]*\]", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("f", i, c, v) for i in range(20) for c, v in (("ref", f"REFERENCE_{i:02d}"), ("other", f"unheard of {i}"), ("none", None))]
    return cut(spark.createDataFrame(rows, "file string, line long, col string, value string"))


def _narrations(spark, every):
    return cut(spark.createDataFrame([(f"NEFT CR REFERENCE_{i:02d} X",) for i in range(0, 20, every)] + [(None,)], "text string"))


def test_the_index_of_runs_is_not_broadcast(spark, cells):
    found = P.quoted_values(cells.filter("col = 'ref'").withColumn("col", F.lit("c")), _narrations(spark, 2))
    assert not [x for x in _broadcast(found) if "gram" in x]
    assert [tuple(r) for r in found.collect()] == [("f", "c", 20, 10)]


def test_columns_that_a_bank_may_echo_are_found_without_a_broadcast(spark, cells, monkeypatch):
    made = []
    monkeypatch.setattr(P, "cut", lambda df: made.append(df) or cut(df))
    found = P.quoted_columns(cells, _narrations(spark, 1))
    assert "gram" in made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for df in (*made, found) for x in _broadcast(df) if "gram" in x]
    assert [tuple(r) for r in found.collect()] == [("f", "ref", 20, 20)]


@pytest.fixture(scope="module")
def kept(spark):
    """A credit, a payout and what is said of them, as files of few bytes."""
    make = lambda rows, schema: cut(spark.createDataFrame(rows, schema))
    money = ", ".join(f"{m} long" for m in ("rows", "payments", "gross", "fee", "tax", "debit_fee", "debit_tax", "debits", "refund_principal", "pay_credit", "expected_net", "allowance"))
    batch = lambda i: (1, f"s{i}", f"UTR{i:09d}", 1, 1, 100 + i, *[0] * 6, 100 + i, 100 + i, 1)
    batches = make([batch(i) for i in range(4)], f"merchant_id long, settlement_id string, settlement_utr string, {money}").withColumn("settled_on", F.lit("2026-07-01").cast("date"))
    credits = make([(1, f"c{i}", 100 + i, f"UTR{i:09d}") for i in range(4)], "merchant_id long, credit_id string, amount long, utr string").withColumn("value_date", F.lit("2026-07-01").cast("date")).withColumn("narration", F.lit("NEFT CR"))
    return credits, cut(batches)


def test_rungs_gather_neither_credits_nor_payouts(spark, kept):
    credits, batches = kept
    attempts = cut(rungs.exact_reference(credits, batches))
    for fits in (rungs.exact_reference(credits, batches), rungs.amount_and_date(credits, batches), group_claims(attempts, batches)):
        assert not [x for x in _broadcast(fits) if re.search("settlement_utr|settled_on|settlement_id", x)]
    assert {(r.credit_id, *r.settlement_ids) for r in attempts.collect()} == {(f"c{i}", f"s{i}") for i in range(4)}


def test_outcomes_and_proofs_are_merged(spark, kept):
    credits, batches = kept
    vetoed = claims.veto(cut(rungs.exact_reference(credits, batches)), credits, batches)
    first = cut(claims.demote_contested(vetoed))
    again = claims.fold(first, cut(first))
    proofs = prove(first, credits, batches)
    assert not [x for df in (again, proofs) for x in _broadcast(df) if "credit_id" in x]
    assert again.count() == 4 and proofs.count() == 4


def test_amounts_that_are_exploded_are_merged(spark):
    short = cut(spark.createDataFrame([(1, "c", ["s"], 5, -100)], "merchant_id long, credit_id string, settlement_ids array<string>, allowance long, residual long"))
    rows = cut(spark.createDataFrame([(1, "r1", "refund", 103, "t", None)], "merchant_id long, entity_id string, type string, debit long, settlement_id string, created_on date"))
    found = recovery_gaps(short, rows, False)
    assert not _broadcast(found) and [r.entity for r in found.collect()] == ["r1"]


def test_grading_gathers_no_credits(spark):
    key = "merchant_id long, credit_id string"
    make = lambda rows, more: cut(spark.createDataFrame(rows, f"{key}, {more}"))
    truth = make([(1, "a", "none", True, True), (1, None, "none", True, True)], "defect string, matchable boolean, provable boolean")
    links = make([(1, "a", "s")], "settlement_id string")
    proofs = make([(1, "a", ["s"], 0, "exact_utr")], "settlement_ids array<string>, drift long, strategy string")
    exceptions = cut(spark.createDataFrame([(1, "a", "UNEXPLAINED")], "merchant_id long, subject_id string, code string"))
    graded = scoring.graded_credits(truth, links, proofs, proofs, exceptions)
    assert not _broadcast(graded) and sorted((r.credit_id or "", r.right) for r in graded.collect()) == [("", False), ("a", True)]


def test_ablation_grades_one_run_at_a_time(spark):
    R.run_of(spark, "/root/testdata/sf0.001")
    cards = QUERIES["e6_ablation"](spark, "/root/testdata/sf0.001")
    assert "Join" not in cards._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.rungs for r in cards.collect()) == [1, 2, 3, 4, 5]


def test_merged_rows_are_the_same(spark, kept):
    credits, _ = kept
    assert merged(credits).collect() == credits.collect() and merged(credits).schema == credits.schema
