"""A folder's report files are settled from a table as from its cells."""

import pytest
from reckoner.operators import profiling as P
from reckoner.sources import statements


@pytest.fixture(scope="module")
def table(spark):
    rows = [("f", i, "Sale" if i % 2 else "Reversal", f"p{i}", f"{i}.50", f"B{i // 4}", f"REFERENCE{i // 4}", "Y") for i in range(24)]
    return spark.createDataFrame(rows, "file string, line long, `The Type` string, `Pay.` string, sum string, batch string, ref string, flag string")


def test_another_column_of_each_files_own(spark, table):
    cells = statements.flat(table)
    against = spark.createDataFrame([("f", "ref"), ("g", "batch")], "file string, col string")
    assert P.paired_columns(table, against).collect() == P.paired_columns(cells, against).collect() == [("f", "batch", 6, 24)]


def test_a_table_is_settled_as_its_cells(spark, table):
    placed = spark.createDataFrame([("f", "settlement_rows")], "file string, kind string")
    known = spark.createDataFrame([(f"p{i}",) for i in range(24)], "value string")
    none = spark.createDataFrame([], "value string")
    said = spark.createDataFrame([(f"NEFT REFERENCE{i} CR",) for i in range(12)], "text string")
    settled = [sorted(tuple(r) for r in P.settle_from_folder(x, placed, known, none, said).collect()) for x in (table, statements.flat(table))]
    assert settled[0] == settled[1] == [("f", "Pay.", "payment_id"), ("f", "The Type", "type"), ("f", "flag", "on_hold"), ("f", "sum", "entity_id")]
