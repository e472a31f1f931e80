"""What becomes of claims: the proof's veto, contested payouts, and the fold over rungs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import merged
from .batches import CREDIT, group_claims

STRINGS = "array<string>"


def veto(attempts: DataFrame, credits: DataFrame, batches: DataFrame) -> DataFrame:
    """Claims whose rows do not rebuild the credit within the allowance are withdrawn; withdrawn_ids keeps them."""
    none = F.array().cast(STRINGS)
    claims = attempts.filter("verdict = 'MATCHED'").select(*CREDIT, "settlement_ids")
    sums = group_claims(claims, batches).select(*CREDIT, "explained", "allowance")
    broken = sums.join(merged(credits.select(*CREDIT, "amount")), CREDIT).filter("abs(amount - explained) > allowance").select(*CREDIT, F.lit(True).alias("broken"))
    gone = F.col("broken").isNotNull()
    return attempts.join(broken, CREDIT, "left").select(
        *CREDIT,
        "strategy",
        F.when(gone, "NO_CANDIDATE").otherwise(F.col("verdict")).alias("verdict"),
        F.when(gone, none).otherwise(F.col("settlement_ids")).alias("settlement_ids"),
        "candidates",
        F.when(gone, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(gone, F.col("settlement_ids")).otherwise(none).alias("withdrawn_ids"),
    )


def demote_contested(attempts: DataFrame) -> DataFrame:
    """A payout that several credits claim is nobody's: each claimant becomes ambiguous and names its rivals.

    A credit in several disputes is blamed on the lowest settlement id.
    """
    none = F.array().cast(STRINGS)
    claims = attempts.filter("verdict = 'MATCHED'").select(*CREDIT, F.explode("settlement_ids").alias("settlement_id"))
    disputed = claims.groupBy("merchant_id", "settlement_id").agg(F.sort_array(F.collect_list("credit_id")).alias("claimants")).filter(F.size("claimants") > 1)
    blamed = (
        disputed.select("merchant_id", "settlement_id", "claimants", F.explode("claimants").alias("credit_id"))
        .groupBy(*CREDIT)
        .agg(F.min(F.struct("settlement_id", "claimants")).alias("blame"))
    )
    lost = F.col("blame").isNotNull()
    return attempts.join(blamed, CREDIT, "left").select(
        *CREDIT,
        "strategy",
        F.when(lost, "AMBIGUOUS").otherwise(F.col("verdict")).alias("verdict"),
        F.when(lost, none).otherwise(F.col("settlement_ids")).alias("settlement_ids"),
        F.when(lost, F.array("blame.settlement_id")).otherwise(F.col("candidates")).alias("candidates"),
        F.when(lost, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        "withdrawn_ids",
        F.when(lost, F.array_remove("blame.claimants", F.col("credit_id"))).otherwise(none).alias("contested_by"),
    )


OUTCOME = ("strategy", "verdict", "settlement_ids", "candidates", "confidence", "withdrawn_ids", "contested_by")


def fold(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """The outcome after a rung: a match ends the search, an ambiguity outlives a miss, a withdrawn claim outlives both.

    before: outcomes of the same credits (all unresolved), or None at the first rung.
    """
    if before is None:
        return now
    b = before.select(*CREDIT, F.struct(*OUTCOME).alias("was"))
    joined = now.select(*CREDIT, F.struct(*OUTCOME).alias("new")).join(merged(b), CREDIT, "left")
    withdrawn = F.when(F.size("new.withdrawn_ids") > 0, F.col("new.withdrawn_ids")).otherwise(F.coalesce("was.withdrawn_ids", F.col("new.withdrawn_ids")))
    old = (F.col("new.verdict") == "NO_CANDIDATE") & (F.col("was.verdict") == "AMBIGUOUS")
    matched = F.col("new.verdict") == "MATCHED"
    picked = [F.when(old, F.col(f"was.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in OUTCOME if c != "withdrawn_ids"]
    return joined.select(*CREDIT, *picked, F.when(matched, F.col("new.withdrawn_ids")).otherwise(withdrawn).alias("withdrawn_ids"))
