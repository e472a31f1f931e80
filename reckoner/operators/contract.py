"""What a report says about its merchant, and the rates that merchant is charged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import apply_rate, implied_rate, rate
from ..functions.rates import PUBLISHED, published_card, rate_band

MINIMUM_ROWS = 12
DOMINANT = "0.6"
BANDS = ("standard", "consumer", "corporate", "international", "gst")


def withholding(rows: DataFrame) -> DataFrame:
    """Whether all settled payments are short by exactly the statutory rate: held, or null where a person must say."""
    paid = (F.col("type") == "payment") & (F.col("credit") != 0)
    exact = paid & (F.col("amount") - F.col("fee") - F.col("tax") - F.col("credit") == apply_rate(F.col("amount"), rate(PUBLISHED["tds"])))
    n, of = F.col("exact"), F.col("of")
    held = F.when(of < MINIMUM_ROWS, F.when(of == 0, False)).when(n == of, True).when(n * 2 <= of, False)
    grouped = rows.groupBy("merchant_id").agg(F.count_if(exact).alias("exact"), F.count_if(paid).alias("of"))
    return grouped.select("merchant_id", F.lit("Section 194-O withholding").alias("finding"), held.alias("held"), F.when(of < MINIMUM_ROWS, 0).otherwise(n).alias("rows"), "of")


def route_and_instant(rows: DataFrame) -> DataFrame:
    """Whether any row is a transfer; whether any payment settled on the day it was made."""
    dated = (F.col("type") == "payment") & F.col("settled_on").isNotNull()
    grouped = rows.groupBy("merchant_id").agg(
        F.count_if(F.col("type") == "transfer").alias("transfers"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(dated & (F.col("created_on") == F.col("settled_on"))).alias("same_day"),
        F.count_if(dated).alias("dated"),
    )
    one = lambda name, n, of: F.struct(F.lit(name).alias("finding"), (F.col(n) > 0).alias("held"), F.col(n).alias("rows"), F.col(of).alias("of"))
    return grouped.select("merchant_id", F.explode(F.array(one("Route transfers", "transfers", "n"), one("Instant settlement", "same_day", "dated"))).alias("f")).select("merchant_id", "f.*")


def profile(rows: DataFrame) -> DataFrame:
    """The three findings of each merchant, with `n of m`."""
    found = withholding(rows).unionByName(route_and_instant(rows))
    share = F.when(F.col("of") == 0, "no rows to read").otherwise(F.concat(F.col("rows").cast("string"), F.lit(" of "), F.col("of").cast("string")))
    return found.withColumn("share", share)


def _votes(pairs: DataFrame) -> DataFrame:
    """merchant, band, charged, base -> the modal four-place rate of each band, the lowest of equals, and how far it holds."""
    voted = pairs.withColumn("rate", implied_rate(F.col("charged"), F.col("base")))
    counts = voted.groupBy("merchant_id", "band", "rate").agg(F.count(F.lit(1)).alias("votes"))
    modal = counts.groupBy("merchant_id", "band").agg(F.min(F.struct((-F.col("votes")).alias("v"), "rate")).alias("m"), F.sum("votes").alias("of"))
    candidate = modal.select("merchant_id", "band", F.col("m.rate").alias("candidate"), "of")
    exact = voted.join(candidate, ["merchant_id", "band"]).groupBy("merchant_id", "band").agg(
        F.first("candidate").alias("candidate"), F.first("of").alias("of"), F.count_if(apply_rate(F.col("base"), F.col("candidate")) == F.col("charged")).alias("exact")
    )
    enough = (F.col("of") >= MINIMUM_ROWS) & (F.col("exact") >= F.col("of") * F.lit(DOMINANT).cast("decimal(3,1)"))
    return exact.select("merchant_id", "band", F.when(enough, F.col("candidate")).alias("rate"), F.when(F.col("of") < MINIMUM_ROWS, 0).otherwise(F.col("exact")).alias("rows"), "of")


def _payments(rows: DataFrame) -> DataFrame:
    return rows.filter("type = 'payment' AND amount > 0 AND method IS NOT NULL")


def induce_platform(rows: DataFrame) -> DataFrame:
    """The contracted rate of each band, if one rate reproduces most of its fees to the paisa."""
    return _votes(_payments(rows).select("merchant_id", rate_band(F.col("method"), F.col("card_type")).alias("band"), F.col("fee").alias("charged"), F.col("amount").alias("base")))


def induce_gst(rows: DataFrame) -> DataFrame:
    """The tax rate, read against the fee."""
    return _votes(_payments(rows).filter("fee > 0").select("merchant_id", F.lit("gst").alias("band"), F.col("tax").alias("charged"), F.col("fee").alias("base")))


def induce_rates(rows: DataFrame) -> DataFrame:
    return induce_platform(rows).unionByName(induce_gst(rows))


def rate_spread(rows: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent implied rates of each band, for bands that would not settle."""
    pairs = _payments(rows).select("merchant_id", rate_band(F.col("method"), F.col("card_type")).alias("band"), implied_rate(F.col("fee"), F.col("amount")).alias("rate"))
    counts = pairs.groupBy("merchant_id", "band", "rate").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("merchant_id", "band").orderBy(F.desc("votes"), "rate")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def rate_cards(rows: DataFrame, induced: bool = True) -> DataFrame:
    """One card for each merchant: published rates, replaced where its own rows concluded, with withholding unless ruled out."""
    held = withholding(rows).select("merchant_id", F.coalesce("held", F.lit(True)).alias("tds_applies"))
    if not induced:
        return held.select("merchant_id", *published_card(), "tds_applies")
    wide = induce_rates(rows).groupBy("merchant_id").agg(*[F.max(F.when(F.col("band") == b, F.col("rate"))).alias(f"_{b}") for b in BANDS])
    pick = lambda name, *bands: F.coalesce(*[F.col(f"_{b}") for b in bands], rate(PUBLISHED[name])).alias(name)
    return held.join(wide, "merchant_id", "left").select(
        "merchant_id",
        pick("standard", "standard", "consumer"), pick("corporate_card", "corporate"), pick("international_card", "international"), pick("gst", "gst"),
        rate(PUBLISHED["tds"]).alias("tds"), rate(PUBLISHED["route"]).alias("route"), "tds_applies",
    )

