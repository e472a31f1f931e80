"""Statements as text: records over several lines, fields, headers."""

import csv
import io
import random

import pytest
from reckoner.operators import profiling
from reckoner.sources import statements as S


def lines_of(spark, files):
    rows = [(name, n, line) for name, text in files.items() for n, line in enumerate(text.removesuffix("\n").split("\n"), 1)]
    return spark.createDataFrame(rows, "file string, line long, text string").repartition(5)


def plain(text):
    reader = csv.reader(io.StringIO(text))
    return [(reader.line_num, [c.strip() for c in cells]) for cells in reader]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_records_are_those_of_a_csv_reader(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_LINES", block)
    rng = random.Random(block)
    files = {"quoted": 'a,b,c\n1,"two\nlines",3\n4,"say ""no""\n\nor\n",6\n"x" y,5" pipe, "z"\n"""",,\n,\n7,8,9', "one": '"a\nb"'}
    for k in range(40):
        cells = lambda: rng.choice(["", "a", "b c", '"', 'x"y', "p\nq", 'n\n"m', ",", 'é', '"\n"', "\n\n"])
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n", quoting=rng.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]))
        writer.writerows([[cells() for _ in range(3)] for _ in range(rng.randint(1, 30))])
        files[f"f{k}"] = out.getvalue().rstrip("\n")
    for k in range(40):  # loose text with quotes anywhere
        files[f"g{k}"] = "".join(rng.choices('a,"\n ', k=rng.randint(1, 60)))
    found = S.records(lines_of(spark, files)).select("file", "line", "refused", S._cells_of(S.F.col("text"), ",").alias("cells")).collect()
    got = {}
    for r in found:
        got.setdefault(r.file, []).append(None if r.refused else (r.line, r.cells))
    for name, text in files.items():
        if list(csv.reader(io.StringIO(f"{text}\nend")))[-1] != ["end"]:  # its last quote is never closed
            assert got[name] == [None]
            continue
        want = [(n, c or [""]) for n, c in plain(text)]
        assert sorted(got[name]) == sorted(want or [(1, [""])]), (name, text)


def test_an_open_quote_refuses_its_file_only(spark):
    files = {"bad": 'day,amount\n1,2\n3,"4\n5,6\n7,8', "long": 'day,amount\n1,"' + "x" * 200_000 + '"\n3,4', "good": 'day,amount\n1,"2"\n3,4'}
    lines = lines_of(spark, files)
    assert {r.file for r in S.records(lines).filter("refused").collect()} == {"bad"}
    assert {r.file for r in S.read_delimited(lines).collect()} == {"good"}


def test_header_footer_and_names(spark):
    text = 'ACME bank\n\n"day","amount","amount",\n1,2,3,\n4,"5\n6",,\n\n7,8\n*** end ***,,,'
    got = {(r.line, r.col): r.value for r in S.read_delimited(lines_of(spark, {"f": text})).collect()}
    assert {c for _, c in got} == {"day", "amount", "amount (3)", "column_4"}
    assert {n for n, _ in got} == {4, 6, 8}
    assert got[6, "amount"] == "5\n6" and got[8, "amount (3)"] == ""


def test_values_quoted_inside_words(spark):
    ids = [f"UTR{k:04d}ABC{k * 37 % 1000:03d}X" for k in range(40)]
    cells = spark.createDataFrame([("g", k, c, v) for k, u in enumerate(ids) for c, v in (("utr", u), ("batch", f"setl_{u[::-1]}"), ("short", u[:5]))], "file string, line long, col string, value string")
    said = spark.createDataFrame([(f"NEFTxx{u}yy ACME",) for u in ids[:30]] + [(f"UTR{k:04d}ABC nothing",) for k in range(40)] + [("short",), (None,)], "text string")
    got = [tuple(r) for r in profiling.quoted_columns(cells, said).collect()]
    assert got == [("g", "utr", 40, 30)]
    assert profiling.quoted_columns(cells, said, 0.8).collect() == []
