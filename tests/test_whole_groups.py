import pytest
from pyspark.sql import functions as F

from reckoner.operators import causes, leaks


@pytest.fixture(scope="module")
def queue(spark):
    schema = "merchant_id long, code string, subject_id string, amount long, summary string, evidence map<string,string>"
    return spark.createDataFrame([(1, "UNSETTLED_PAYMENT", f"pay_{i:04d}", 10, "", {"method": "upi"}) for i in range(30)], schema)


def test_a_cause_names_all_its_members(queue):
    assert causes.induce(queue, None).first().member_ids == [f"pay_{i:04d}" for i in range(30)]


def test_a_rule_names_all_its_members(queue):
    assert causes.one_rule(queue, 8, None).first().member_ids == [f"pay_{i:04d}" for i in range(30)]


def test_a_cluster_names_all_its_payments(spark):
    row = "payment_id, 1L merchant_id, 0.02 contracted_rate, 0.0215 charged_rate, 'card' method, 'domestic_consumer' card_type, 'Visa' card_network, 1L overcharge, 0L gst_on_overcharge, 100L gross, date'2026-07-01' settled_on"
    found = spark.range(30).select(F.format_string("pay_%04d", "id").alias("payment_id")).selectExpr(*row.split(", "))
    assert leaks.clusters(found, None).first().payment_ids == [f"pay_{i:04d}" for i in range(30)]
