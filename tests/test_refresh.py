"""Kept runs: refused when stale, renewed for changed merchants alone; causes and clusters with their members apart."""

import dataclasses

import pytest
from pyspark.sql import functions as F
from reckoner.operators import causes, leaks
from reckoner.operators.members import MOST_SHOWN, shown
from reckoner.operators.rungs import PLAIN_RUNGS, RUNGS
from reckoner.plans import refresh as R
from reckoner.plans.reconcile import reconcile, run_of
from reckoner.sources import store

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return run_of(spark, FOLDER, PLAIN_RUNGS)


@pytest.fixture(scope="module")
def kept(run, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("kept") / "run")
    R.record(run, folder, PLAIN_RUNGS)
    return folder


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def _merchants(df):
    return {r.merchant_id for r in df.collect()}


def _credits(run, change):
    return dataclasses.replace(run.ledger, credits=change(run.ledger.credits))


def test_same_ledger_gives_the_kept_outcomes(run, kept):
    assert _merchants(R.changed_merchants(run.ledger, kept, PLAIN_RUNGS)) == set()
    assert _rows(R.kept_outcome(run.ledger, kept, PLAIN_RUNGS)) == _rows(run.outcome)


def test_a_changed_merchant_alone_runs_again(spark, run, kept, tmp_path):
    one = run.ledger.credits.agg(F.min_by("merchant_id", F.struct("merchant_id", "credit_id")).alias("m"), F.min(F.struct("merchant_id", "credit_id"))["credit_id"].alias("c")).first()
    hit = (F.col("merchant_id") == one.m) & (F.col("credit_id") == one.c)
    ledger = _credits(run, lambda df: df.withColumn("amount", F.when(hit, F.col("amount") + 1).otherwise(F.col("amount"))))
    assert _merchants(R.changed_merchants(ledger, kept, PLAIN_RUNGS)) == {one.m}
    with pytest.raises(R.StaleRun):
        R.kept_outcome(ledger, kept, PLAIN_RUNGS)
    assert _rows(R.refresh(ledger, kept, PLAIN_RUNGS)) == _rows(reconcile(ledger, PLAIN_RUNGS).outcome)
    # Outcomes of other merchants are the kept ones, whatever they say.
    marked = str(tmp_path / "marked")
    store.save(spark.read.parquet(f"{kept}/outcome").withColumn("strategy", F.lit("kept")), f"{marked}/outcome")
    store.save(spark.read.parquet(f"{kept}/digests"), f"{marked}/digests")
    again = R.refresh(ledger, marked, PLAIN_RUNGS)
    assert _merchants(again.filter("strategy <> 'kept'")) == {one.m}
    assert _merchants(again.filter("strategy = 'kept'")) == _merchants(run.outcome) - {one.m}


def test_a_merchant_that_is_gone_has_no_outcomes(run, kept):
    gone = run.ledger.credits.agg(F.max("merchant_id")).first()[0]
    left = dataclasses.replace(run.ledger, **{n: getattr(run.ledger, n).filter(F.col("merchant_id") != gone) for n in ("orders", "payments", "rows", "credits")})
    assert _merchants(R.changed_merchants(left, kept, PLAIN_RUNGS)) == {gone}
    assert _rows(R.refresh(left, kept, PLAIN_RUNGS)) == _rows(run.outcome.filter(F.col("merchant_id") != gone))


def test_other_rungs_make_a_kept_run_stale(run, kept):
    assert _merchants(R.changed_merchants(run.ledger, kept, RUNGS)) >= _merchants(run.ledger.credits)


def test_digests_tell_nulls_and_columns_apart(spark):
    rows = [[("a", None)], [("a", "")], [("a|", "b")], [("a", "|b")], [("a", "b"), ("a", "b")], [("a", "b")]]
    digest = lambda r: tuple(store.fingerprint(spark.createDataFrame(r, "x string, y string"), ["x", "y"]).first())
    assert len({digest(r) for r in rows}) == len(rows)
    many = spark.range(300_000).select(F.lit(1).alias("m"), F.col("id").cast("string").alias("x"))
    assert store.fingerprint(many, ["x"], ["m"]).first().digest == store.fingerprint(many.repartition(7), ["x"], ["m"]).first().digest


def test_shown_members_are_the_first_few(spark):
    df = spark.createDataFrame([("big", f"{i:03d}") for i in range(100)] + [(None, "z"), (None, "a")], "g string, id string")
    got = {r.g: r.ids for r in shown(df, ["g"], "id", "ids").collect()}
    assert got == {"big": [f"{i:03d}" for i in range(MOST_SHOWN)], None: ["a", "z"]}


def test_causes_have_all_members_in_a_table(spark):
    schema = "merchant_id long, code string, subject_id string, amount long, summary string, evidence map<string,string>"
    day = {"settled_on": "2026-07-01", "batches_that_day": "2"}
    queue = [(1, "UNSETTLED_PAYMENT", f"pay_{i:04d}", 10, "", {"method": "upi"}) for i in range(500)]
    queue += [(1, "MISSING_SETTLEMENT", "s1", 5, "", day), (1, "MISSING_SETTLEMENT", "s2", 5, "", day), (1, "MISSING_SETTLEMENT", "s3", 7, "", {"settled_on": "2026-07-02", "batches_that_day": "2"})]
    queue += [(2, "TAX_DEDUCTION", "c1", 1, "", {"rate_applied": "12%"}), (2, "UNEXPLAINED", "c2", 1, "", {"reason": "ambiguous"})]
    df = spark.createDataFrame(queue, schema)
    members = causes.members(causes.assign(df))
    assert {(r.merchant_id, r.rule_no, r.cause_key): r["count"] for r in members.groupBy(*causes.CAUSE).count().collect()} == {(1, 4, "2026-07-01"): 2, (1, 9, "all"): 500}
    found = {r.rule_no: r for r in causes.induce(df).collect()}
    assert found[9].members == 500 and found[9].member_ids == [f"pay_{i:04d}" for i in range(MOST_SHOWN)] and found[9].total == 5000
    assert found[4].member_ids == ["s1", "s2"] and set(found) == {4, 9}
    assert causes.induce(df.limit(0)).count() == 0 and causes.assign(df).count() == len(queue)


def test_clusters_name_the_first_payments(run):
    found = leaks.charged_above_contract(run.ledger.rows, run.rates)
    clusters = leaks.clusters(found)
    assert clusters.agg(F.sum("payments")).first()[0] == found.count()
    assert clusters.filter(F.size("payment_ids") != F.least(F.col("payments"), F.lit(MOST_SHOWN))).count() == 0
