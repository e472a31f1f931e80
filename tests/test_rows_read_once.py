"""Text files are read as rows: only files with quoted line breaks are put together, and no cell meets its row again."""

from reckoner.sources import statements as S


def test_lines_without_open_quotes_are_records_as_they_stand(spark):
    plain = {"p": 'day,note\n1,"a ""b"", c"\n2,x"y\n3,', "q": "day,note\n1,2"}
    broken = {"b": 'day,note\n1,"two\nlines"\n2,z'}
    of = lambda files: spark.createDataFrame([(f, n, t) for f, text in files.items() for n, t in enumerate(text.split("\n"), 1)], "file string, line long, text string")
    alone = S.records(of(plain))
    assert "Window" not in alone._jdf.queryExecution().optimizedPlan().toString()
    both = {(r.file, r.line, r.text) for r in S.records(of(plain | broken)).collect()}
    assert both == {(f, n, t) for f, text in plain.items() for n, t in enumerate(text.split("\n"), 1)} | {("b", 1, "day,note"), ("b", 3, '1,"two\nlines"'), ("b", 4, "2,z")}


def test_rows_stand_under_their_headers(spark):
    text = 'bank\n\nday,amount,amount,\n1,2,3,4\n5,"6, 7"\n*** end ***,,,'
    rows, heads = S.read_rows(spark.createDataFrame([("f", n, t) for n, t in enumerate(text.split("\n"), 1)], "file string, line long, text string"))
    assert [r.names for r in heads.collect()] == [["day", "amount", "amount (3)", "column_4"]]
    assert sorted((r.line, r.values) for r in rows.collect()) == [(4, ["1", "2", "3", "4"]), (5, ["5", "6, 7", "", ""])]
