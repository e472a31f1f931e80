"""Working days: weekends are skipped, holidays are not known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMESTIC_DAYS, INTERNATIONAL_DAYS = 2, 7
MONDAY = "1970-01-05"


def add_working_days(start: Column, count: Column | int) -> Column:
    """The day after `count` working days from start (count >= 0), in closed form."""
    n = F.lit(count) if isinstance(count, int) else count
    day = F.weekday(start)
    moved = n - F.greatest(F.lit(0), day - 4) + 2 * F.floor((F.least(day, F.lit(4)) + n) / 5).cast("int")
    return F.when(n == 0, start).otherwise(F.date_add(start, moved.cast("int")))


def next_working_day(day: Column) -> Column:
    return F.when(F.weekday(day) < 5, day).otherwise(add_working_days(day, 1))


def _working_days_to(day: Column) -> Column:
    """Working days from a fixed Monday up to and including a day."""
    n = F.datediff(day, F.lit(MONDAY).cast("date")) + 1
    return 5 * F.floor(n / 7) + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def working_days_between(start: Column, end: Column) -> Column:
    """Signed working days advanced from start to end."""
    ahead = _working_days_to(end) - _working_days_to(start)
    back = _working_days_to(F.date_sub(end, 1)) - _working_days_to(F.date_sub(start, 1))
    return F.when(end >= start, ahead).otherwise(back).cast("int")


def settlement_due(captured_on: Column, card_type: Column) -> Column:
    """Two working days after capture, seven for international cards."""
    days = F.when(card_type == "international", INTERNATIONAL_DAYS).otherwise(DOMESTIC_DAYS)
    return add_working_days(captured_on, days)
