"""A whole run over the smallest ledger: what must always hold, and the queries against their SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F
from reckoner.operators import causes, triage
from reckoner.operators.batches import CREDIT
from reckoner.plans.reconcile import run_of
from reckoner.plans.registry import ORACLE_SQL, QUERIES
from reckoner.sources import statements, store

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return run_of(spark, FOLDER)


def test_every_credit_is_proved_or_excepted(spark, run):
    queue = triage.exceptions(run)
    named = queue.select("merchant_id", F.col("subject_id").alias("credit_id"))
    proved = run.proofs.select(*CREDIT)
    assert run.ledger.credits.select(*CREDIT).join(proved, CREDIT, "left_anti").join(named, CREDIT, "left_anti").count() == 0
    assert proved.join(named, CREDIT).count() == 0


def test_no_settlement_is_claimed_twice_and_drift_is_small(run):
    claimed = run.proofs.select("merchant_id", F.explode("settlement_ids").alias("s")).groupBy("merchant_id", "s").count()
    assert claimed.filter("count > 1").count() == 0
    assert run.proofs.filter("abs(drift) > allowance").count() == 0


def test_proofs_are_right(run):
    links = run.ledger.truth_links.groupBy(*CREDIT).agg(F.array_sort(F.collect_list("settlement_id")).alias("expected"))
    wrong = run.proofs.join(links, CREDIT, "left").filter("NOT settlement_ids <=> expected")
    assert wrong.count() == 0 and run.proofs.count() > 0


def test_causes_keep_members_apart(run):
    queue = triage.exceptions(run)
    assigned = causes.assign(queue)
    assert assigned.count() == queue.count()
    assert causes.induce(queue).agg(F.sum("members")).first()[0] == assigned.filter("rule_no IS NOT NULL").count()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


SOME = [
    "a1_batches", "a6_profile", "a9_rate_card", "a10_leak_clusters", "j1_exact_reference", "j2_amount_and_date", "j3_subset_sum", "j5_shortfall", "j7_contested", "j9_cascade_plain", "j10_proof_lines", "j14_recovery_gaps",
    "j15_nearest_refunds", "c6_exception_queue", "c8_undisclosed_rate", "k4_commitments", "k8_accuracy", "e1_scorecard", "e7_pooled", "q14_proof_lookup", "q16_queue_subjects", "s5_bank_credits", "s6_settlement_rows", "p1_column_profile", "p14_paired_columns",
]


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(_plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    found = db.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_read_delimited(spark):
    lines = ["My Bank,,", "", "Date,Narration,Amount,Amount,", '01-07-2026,"NEFT, ""X""",5,6,', "02-07-2026,short", ",,,,", "03-07-2026,c,7,8,9", "*** End ***,,,,"]
    df = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(lines)], "file string, line long, text string")
    got = {}
    for r in statements.read_delimited(df).collect():
        got.setdefault(r.line, {})[r.col] = r.value
    assert sorted(got) == [4, 5, 7]
    assert got[4] == {"Date": "01-07-2026", "Narration": 'NEFT, "X"', "Amount": "5", "Amount (4)": "6", "column_5": ""}
    assert got[5]["Amount"] == "" and got[7]["column_5"] == "9"


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "merchant_id long, x string")
    store.save(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    recorded = store.fingerprint(df, ["merchant_id", "x"])
    assert store.unchanged(back, ["merchant_id", "x"], recorded)
    assert not store.unchanged(back.limit(1), ["merchant_id", "x"], recorded)


def test_rest_works_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith(('op', 'pipeline')) for n in q); assert e.oracle_sql(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
