"""The fee stack of a merchant. A rate card is one row: its columns are the arguments here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import apply_rate, rate

#: Published pricing.
PUBLISHED = {"standard": "0.0200", "corporate_card": "0.0215", "international_card": "0.0300", "gst": "0.1800", "tds": "0.0100", "route": "0.0010"}
#: Flat charges for instant refunds, in paise: up to 1,000 rupees, up to 25,000, above.
REFUND_SLABS = ((100_000, 799), (2_500_000, 1199))
REFUND_TOP = 1499


def published_card() -> list[Column]:
    return [rate(value).alias(name) for name, value in PUBLISHED.items()]


def platform_rate(method: Column, card_type: Column, standard: Column, corporate: Column, international: Column) -> Column:
    return F.when((method == "card") & (card_type == "domestic_corporate"), corporate).when((method == "card") & (card_type == "international"), international).otherwise(standard)


def deductions(amount: Column, contracted: Column, gst: Column, tds: Column, tds_applies: Column) -> dict[str, Column]:
    """fee off gross, GST on the fee, withholding on gross, and the net."""
    fee = apply_rate(amount, contracted)
    tax = apply_rate(fee, gst)
    withheld = F.when(tds_applies, apply_rate(amount, tds)).otherwise(F.lit(0).cast("long"))
    return {"fee": fee, "tax": tax, "tds": withheld, "net": amount - fee - tax - withheld}


def instant_refund_fee(amount: Column) -> Column:
    out = F.lit(REFUND_TOP)
    for ceiling, fee in reversed(REFUND_SLABS):
        out = F.when(amount <= ceiling, fee).otherwise(out)
    return out.cast("long")


def rate_band(method: Column, card_type: Column) -> Column:
    """Which contracted rate a row's own columns put it on."""
    return F.when((method != "card") | card_type.isNull(), "standard").when(card_type == "domestic_corporate", "corporate").when(card_type == "international", "international").otherwise("consumer")


def widest_deduction() -> Column:
    """The most of gross that a rate card's fee stack can take."""
    worst = F.greatest("standard", "corporate_card", "international_card")
    return worst * (1 + F.col("gst")) + F.when(F.col("tds_applies"), F.col("tds")).otherwise(F.lit(0))
