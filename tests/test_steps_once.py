"""What a run has found once is not sought again, and what is kept is read by column."""

import pytest
from pyspark.sql import functions as F
from reckoner.operators import triage
from reckoner.plans import reconcile as R
from reckoner.plans.registry import QUERIES
from reckoner.sources.session import cut

FOLDER = "/root/testdata/sf0.001"


def test_kept_rows_are_read_by_column(spark):
    df = spark.createDataFrame([(1, "a", {"k": "v"}, [1, None]), (2, None, None, None)], "id long, text string, pairs map<string,string>, list array<int>")
    kept = cut(df)
    assert kept.schema == df.schema and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "id" in plan and "text" not in plan


def test_rows_that_parquet_cannot_hold_are_kept(spark):
    odd = spark.range(2).select("id", F.lit(None).alias("nothing"))
    assert cut(odd).collect() == odd.collect()
    twin = spark.range(1).select(F.col("id"), F.col("id").alias("ID"))
    assert cut(twin).columns == ["id", "ID"]
    assert cut(spark.range(0)).count() == 0


def test_ablation_tries_no_rung_again(spark, monkeypatch):
    R.run_of(spark, FOLDER)
    monkeypatch.setattr(R, "cascade_steps", lambda *a, **k: pytest.fail("the rungs were tried again"))
    assert QUERIES["e6_ablation"](spark, FOLDER).count() == len(R.RUNGS)


@pytest.mark.parametrize("name", ["e5_rates", "e7_pooled"])
def test_grading_makes_no_queue(spark, monkeypatch, name):
    monkeypatch.setattr(triage, "absences", lambda run: pytest.fail("payouts and payments were named"))
    R.run_of(spark, FOLDER)
    assert QUERIES[name](spark, FOLDER).count() > 0
