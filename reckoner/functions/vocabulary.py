"""Closed lists that cells are read against, and dates under named patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise_name

#: Members of each list, and other words for them.
ENTITY = {
    "payment": "sale capture captured payments credit",
    "refund": "refunds credit_note reversal",
    "adjustment": "chargeback dispute adj adjustments",
    "transfer": "transfers route_transfer split",
}
METHOD = {
    "card": "credit_card debit_card cards cc dc",
    "upi": "upi_collect upi_intent",
    "netbanking": "net_banking internet_banking nb",
    "wallet": "wallets prepaid_wallet",
    "emi": "emi_card",
    "paylater": "pay_later buy_now_pay_later bnpl",
}
CARD_TYPE = {
    "domestic_consumer": "domestic consumer retail personal",
    "domestic_corporate": "corporate commercial business",
    "international": "intl foreign overseas",
}
TRUE, FALSE = ("y", "yes", "true", "t", "1"), ("n", "no", "false", "f", "0")
#: Date shapes, day first and month first, with the times that may follow.
DATES = ("yyyy-M-d", "d-M-yyyy", "M-d-yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d.M.yyyy", "d-MMM-yyyy", "d MMM yyyy", "d-MMMM-yyyy", "MMM d, yyyy", "d-M-yy", "M-d-yy", "d/M/yy", "M/d/yy")
TIMES = ("", " H:m:s", " H:m", " H:m:s.SSSSSS")
ISO = "ISO"
PATTERNS = (ISO, *(f"{d}{t}" for d in DATES for t in TIMES))


def words(vocabulary: dict[str, str]) -> dict[str, str]:
    """Every accepted word with its member."""
    return {w: member for member, others in vocabulary.items() for w in (member, *others.split())}


def member_of(raw: Column, vocabulary: dict[str, str]) -> Column:
    """The list's member that a cell names, or null. No word of a list has a digit, so that a cell with one need not be folded."""
    entries = [F.lit(x) for pair in words(vocabulary).items() for x in pair]
    return F.when(~F.coalesce(raw, F.lit("")).rlike("[0-9]"), F.try_element_at(F.create_map(*entries), normalise_name(F.coalesce(raw, F.lit("")))))


def parse_bool(raw: Column) -> Column:
    text = F.lower(F.trim(raw))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def maybe_temporal(raw: Column) -> Column:
    """Whether a cell has the outline that all the patterns share; others need not be read under each of them."""
    return F.trim(raw).rlike(r"^(?:\d{1,4}[-/. ](?:\d{1,2}|[A-Za-z]+)[-/. ]\d{1,4}|[A-Za-z]{3} \d{1,2}, \d{4})(?:[T ][\d:.]+(?:Z|[+-]\d{2}:?\d{2})?)?$")


def parse_temporal(raw: Column, pattern: str) -> Column:
    """A time under one named pattern, never another; null where it does not fit. Time zones are dropped."""
    text = F.trim(raw)
    if pattern == ISO:
        shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
        plain = F.regexp_replace(text, r"(Z|(?<=:\d{2})[+-]\d{2}:?\d{2}|(?<=\.\d{1,6})[+-]\d{2}:?\d{2})$", "")
        return F.when(text.rlike(shape), plain.try_cast("timestamp_ntz"))
    date, _, time = pattern.partition(" H")
    digits = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}", "SSSSSS": r"\d{1,6}"}
    shape, at = "", 0
    while at < len(pattern):
        part = next((k for k in ("SSSSSS", "yyyy", "MMMM", "MMM", "yy", "M", "d", "H", "m", "s") if pattern.startswith(k, at)), None)
        shape += digits[part] if part else pattern[at].replace(".", r"\.")
        at += len(part) if part else 1
    fraction = "SSSSSS" in pattern
    cut = F.regexp_replace(text, r"\.\d+$", "") if fraction else text
    read = F.try_to_timestamp(F.when(text.rlike(f"^{shape}$"), cut), F.lit(pattern.replace(".SSSSSS", "") if fraction else pattern))
    return read.cast("timestamp_ntz")
