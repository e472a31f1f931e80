"""What is read once for each value, or not at all, must come out as if every cell were read."""

import pytest
from pyspark.sql import functions as F

from reckoner.functions.money import parse_money
from reckoner.functions.vocabulary import PATTERNS, maybe_temporal, parse_temporal
from reckoner.operators import profiling as P
from reckoner.sources import statements


def _columns(spark, columns):
    return spark.createDataFrame([("f", i, c, v) for c, values in columns.items() for i, v in enumerate(values)], "file string, line long, col string, value string")


def test_an_outline_leaves_no_date_out(spark):
    said = ["2026-07-01", "1-7-2026", "01/07/26", "1.7.2026", "1-Jul-2026", "1 Jul 2026", "1-July-2026", "Jul 1, 2026", "2026/7/1 9:05", "2026-07-01T09:05:06.123+05:30", " 7/1/2026 23:59:59.5 ", "2026-07-01 09:05:06Z"]
    values = spark.createDataFrame([(v,) for v in said], "value string")
    read = F.coalesce(*[parse_temporal(F.col("value"), p).isNotNull() | F.lit(None).cast("boolean") for p in PATTERNS])
    assert values.filter(read & ~maybe_temporal(F.col("value"))).count() == 0 and values.filter(read).count() == len(said)


def test_plain_and_other_amounts(spark):
    want = {"12.50": 1250, "1,234": 123400, "00012.5": 1250, "₹1₹2": 1200, "(5)": -500, "5 Cr": 500, "Rs.-5": -500, "01-07-2026": None, "5-": None, "1234567890123456": None, "123456789012345": 12345678901234500, "12.50\n": 1250}
    df = spark.createDataFrame([(k,) for k in want], "v string").select("v", parse_money(F.col("v")).alias("p"))
    assert {r.v: r.p for r in df.collect()} == want


def test_yes_and_no_among_other_values(spark):
    mostly = ["y"] * 99
    cells = _columns(spark, {"two": mostly + ["pay_1"], "four": mostly + ["pay_1", "pay_2", "pay_3"], "forms": ["y", "Y", "yes", "no"], "long": ["yes" + " " * 40, "no"]})
    found = {r.col for r in P.fitting(cells).filter("value_kind = 'boolean'").collect()}
    assert found == {"two", "long"}
    old = P.fits(P.profile(cells), P.date_patterns(cells))
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, P.fitting(cells).collect()))


@pytest.fixture(scope="module")
def table(spark):
    rows = [("f", i, f"B{i // 4}", f"U{i // 4}", f"id{i}", "Y" if i < 20 else "N") for i in range(24)]
    return spark.createDataFrame(rows, "file string, line long, batch string, ref string, id string, flag string")


def test_a_table_gives_what_its_cells_give(spark, table):
    cells = statements.flat(table)
    against = spark.createDataFrame([("f", "ref")], "file string, col string")
    assert P.paired_columns(table, "ref").collect() == P.paired_columns(cells, against).collect() == [("f", "batch", 6, 24)]


def test_a_kind_is_rendered_alone(spark):
    gateway = statements.render(spark, "/root/testdata/sf0.001", "gateway")
    text = gateway._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in text.split("Window")[0] and text.count("Window") == 1
