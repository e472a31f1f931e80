import datetime as dt

import pytest
from pyspark.sql import functions as F
from reckoner.functions import calendar, money, text, vocabulary


@pytest.mark.parametrize("raw, paise", [
    ("1,02,278.84", 10227884), ("₹ 1,234", 123400), ("Rs. 12.5 Cr", 1250), ("12.50 Dr", -1250), ("(99.00)", -9900), ("-7", -700), ("+ 7.005", 701), ("INR 5", 500),
    ("", None), ("  ", None), ("abc", None), ("1,,2", None), ("1234567890123456", None), ("000000000000000000012", 1200), ("12.", None), (None, None),
])
def test_parse_money(spark, raw, paise):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(money.parse_money(F.col("raw"))).first()[0] == paise


def test_format_inr(spark):
    cases = {0: "Rs 0.00", 5: "Rs 0.05", 99900: "Rs 999.00", 100000: "Rs 1,000.00", 10227884: "Rs 1,02,278.84", -1234567890: "-Rs 1,23,45,678.90"}
    df = spark.createDataFrame([(k,) for k in cases], "p long")
    assert {r.p: r.s for r in df.select("p", money.format_inr(F.col("p")).alias("s")).collect()} == cases


def walk(start, n):
    day = start
    while n:
        day += dt.timedelta(1)
        n -= day.weekday() < 5
    return day


def between(start, end):
    if start == end:
        return 0
    step = 1 if end > start else -1
    day, n = start, 0
    while day != end:
        day += dt.timedelta(step)
        n += day.weekday() < 5
    return n * step


def test_working_days(spark):
    first = dt.date(2026, 6, 25)
    rows = [(first + dt.timedelta(i), n, first + dt.timedelta((i * 7 + n * 5) % 40)) for i in range(21) for n in range(9)]
    df = spark.createDataFrame(rows, "s date, n int, e date").select("s", "n", "e", calendar.add_working_days(F.col("s"), F.col("n")).alias("a"), calendar.working_days_between(F.col("s"), F.col("e")).alias("b"), calendar.next_working_day(F.col("s")).alias("x"))
    for r in df.collect():
        assert r.a == walk(r.s, r.n) and r.b == between(r.s, r.e)
        assert r.x == (r.s if r.s.weekday() < 5 else walk(r.s, 1))


@pytest.mark.parametrize("raw, pattern, want", [
    ("06-07-2026", "d-M-yyyy", "2026-07-06 00:00:00"), ("06-07-2026", "M-d-yyyy", "2026-06-07 00:00:00"), ("2026-07-06T10:20:30Z", "ISO", "2026-07-06 10:20:30"), ("2026-07-06", "ISO", "2026-07-06 00:00:00"),
    ("6 Jul 2026 09:05", "d MMM yyyy H:m", "2026-07-06 09:05:00"), ("31-02-2026", "d-M-yyyy", None), ("06/07/26", "d/M/yy", "2026-07-06 00:00:00"), ("06-07-2026 1", "d-M-yyyy", None), ("", "ISO", None),
])
def test_parse_temporal(spark, raw, pattern, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(vocabulary.parse_temporal(F.col("raw"), pattern).cast("string")).first()[0]
    assert got == want


def test_text(spark):
    df = spark.createDataFrame([("neft-eiqo7rmb8q93-razorpay software pvt ltd",), ("NEFT ACME TRADERS PVT REF1001 DHL UPS",), ("RAZORPAYSOFTWARE ABCDEFGHIJKLM",)], "n string")
    got = [tuple(r) for r in df.select(text.extract_reference(F.col("n")), text.narration_letters(F.col("n")), text.payer_stem(F.col("n"))).collect()]
    assert got[0][0] == "EIQO7RMB8Q93" and got[0][1] == "EIQO7RMB8Q93"
    assert got[1][0] is None and got[1][2] == "ACME TRADERS PVT REF"
    assert got[2][0] is None
    names = spark.createDataFrame([("Settled At",), ("SETTLED-AT",), (" _x_ ",)], "n string").select(text.normalise_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["settled_at", "settled_at", "x"]
