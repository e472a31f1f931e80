import hashlib
import re

import numpy as np
import pytest
from reckoner.llm import exact as X


def brute(rows):
    norm = {i: re.sub("[ \t-\r]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


@pytest.mark.parametrize("budget", [X.BUDGET_BYTES, 2000])
def test_matches_brute_force(spark, budget):
    rng = np.random.default_rng(1)
    rows = [(0, None), (1, ""), (2, " "), (3, "\t\n "), (4, "a  b"), (5, "a b"), (6, "a\x0b\x0cb"), (7, "a b"), (8, "a b "), (9, "x" * 300_000), (10, "x" * 300_000), (11, "x" * 299_999 + "y"), (12, "aa"), (13, "a")]
    rows += [(i, "".join(rng.choice(list("ab \nü"), int(rng.integers(1, 6))))) for i in range(14, 400)]
    rows += [(i, "hot text of many copies") for i in range(400, 800)]
    docs = spark.createDataFrame([(t, i, -1, True) for i, t in rows], "text string, doc_id long, keep_id long, kept boolean").repartition(5)
    assert {tuple(r)[:5] for r in X.exact_groups(docs, budget_bytes=budget).collect()} == brute(rows)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (4, "a"), (None, "b"), (None, "b"), (5, "c"), (5, "c"), (5, "d"), (6, "c")], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in X.exact_groups(docs).collect()), key=repr)
    assert got == sorted([(None, 4, 2, False), (4, 4, 2, True), (None, None, 2, True), (None, None, 2, False), (5, 5, 3, True), (5, 5, 3, False), (5, 5, 1, True), (6, 5, 3, False)], key=repr)


def test_rows_are_named_by_their_place(spark, tmp_path):
    """Kept rows are found again by ROW, also in a table of several files."""
    spark.createDataFrame([(i, f"text {i % 40}") for i in range(200)], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    docs = X.keyed(spark.read.parquet(str(tmp_path / "t")))
    kept = X.groups_of(docs).filter("kept").select(*X.ROW)
    assert sorted(r.doc_id for r in docs.join(kept, X.ROW, "left_semi").collect()) == list(range(40))
    assert X.keyed(docs.drop(*X.ROW).unionAll(docs.drop(*X.ROW))).select(*X.ROW).distinct().count() == 400


def test_empty(spark):
    assert X.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
