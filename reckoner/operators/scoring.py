"""Measuring a run against what is known to be true."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import merged
from .batches import CREDIT


def graded_credits(truth: DataFrame, truth_links: DataFrame, proofs: DataFrame, shortfalls: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Each credit with its true settlements and what the run said of it."""
    expected = truth_links.groupBy(*CREDIT).agg(F.array_sort(F.collect_list("settlement_id")).alias("expected"))
    proved = proofs.select(*CREDIT, F.array_sort("settlement_ids").alias("proved"), "drift", "strategy")
    short = shortfalls.select(*CREDIT, F.array_sort("settlement_ids").alias("short"))
    named = exceptions.filter("code <> 'UNEXPLAINED'").select("merchant_id", F.col("subject_id").alias("credit_id")).distinct().withColumn("named", F.lit(True))
    g = truth
    for said in (expected, proved, short, named):
        g = g.join(merged(said), CREDIT, "left")
    claim = F.coalesce("proved", "short")
    return g.select(
        *CREDIT, "defect", "matchable", "provable", "drift", "strategy",
        F.size(F.coalesce("expected", F.array().cast("array<string>"))).alias("members"),
        F.col("proved").isNotNull().alias("claimed"),
        F.coalesce(F.col("matchable") & (F.col("proved") == F.col("expected")), F.lit(False)).alias("right"),
        F.coalesce(F.col("matchable") & (claim == F.col("expected")), F.lit(False)).alias("attributed"),
        F.coalesce("named", F.lit(False)).alias("named"),
    )


def scorecard(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of right and wrong claims, refusals, shortfalls named and merged credits resolved."""
    resolvable, short = F.col("matchable") & F.col("provable"), F.col("matchable") & ~F.col("provable")
    impossible, claimed, right = ~F.col("matchable"), F.col("claimed"), F.col("right")
    count = lambda c, name: F.count_if(c).alias(name)
    return graded.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("credits"), count(resolvable, "matchable"), count(impossible, "impossible"),
        count(claimed & right, "true_positives"), count(claimed & ~right, "false_positives"), count(resolvable & ~claimed, "false_negatives"),
        count(impossible & ~claimed, "correct_refusals"), count(F.col("matchable") & F.col("attributed"), "attributed"),
        count(short, "unprovable"), count(short & F.col("named"), "unprovable_named"),
        count(F.col("members") > 1, "merged"), count(claimed & right & (F.col("members") > 1), "merged_resolved"),
        count(claimed & (F.col("drift") != 0), "proofs_with_drift"), F.sum(F.coalesce("drift", F.lit(0))).alias("drift_net"), F.sum(F.abs(F.coalesce("drift", F.lit(0)))).alias("drift_gross"),
    )


def ratio(hit, of):
    return F.coalesce(F.try_divide(F.col(hit) if isinstance(hit, str) else hit, F.col(of) if isinstance(of, str) else of), F.lit(0.0)).cast("double")


def rates(card: DataFrame) -> DataFrame:
    """A scorecard with its rates; a rate over nothing is 0."""
    return (
        card.withColumn("match_rate", ratio("true_positives", "matchable"))
        .withColumn("precision", ratio("true_positives", F.col("true_positives") + F.col("false_positives")))
        .withColumn("refusal_rate", ratio("correct_refusals", "impossible"))
        .withColumn("attribution_rate", ratio("attributed", F.col("matchable") + F.col("unprovable")))
        .withColumn("explained_rate", ratio("unprovable_named", "unprovable"))
        .withColumn("merged_rate", ratio("merged_resolved", "merged"))
    )


def by_defect(graded: DataFrame) -> DataFrame:
    """For each defect, credits that should have matched and did not, and shortfalls left unnamed."""
    resolvable, short = F.col("matchable") & F.col("provable"), F.col("matchable") & ~F.col("provable")
    return graded.groupBy("defect").agg(F.count_if(resolvable & ~F.col("claimed")).alias("unresolved"), F.count_if(short & ~F.col("named")).alias("unexplained"))


def leak_score(leaks: DataFrame, leak_truth: DataFrame) -> DataFrame:
    """Leaks expected, found and wrongly claimed, recall and precision, for each merchant."""
    key = ["merchant_id", "payment_id"]
    said = leaks.select(*key).distinct().withColumn("said", F.lit(True))
    real = leak_truth.select(*key).distinct().withColumn("real", F.lit(True))
    both = said.join(real, key, "full")
    card = both.groupBy("merchant_id").agg(F.count("real").alias("expected"), F.count_if(F.col("said") & F.col("real")).alias("found"), F.count_if(F.col("said") & F.col("real").isNull()).alias("false_leaks"))
    return card.withColumn("recall", ratio("found", "expected")).withColumn("precision", ratio("found", F.col("found") + F.col("false_leaks")))


def pool(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Counts pooled over runs (hit, total), and the range of the runs' own rates."""
    own = F.when(F.col("total") != 0, F.col("hit") / F.col("total"))
    spread = lambda f, name: F.coalesce(f(own), F.lit(0.0)).alias(name)
    grouped = pairs.groupBy(*by).agg(F.sum("hit").alias("numerator"), F.sum("total").alias("denominator"), spread(F.min, "lowest"), spread(F.median, "middle"), spread(F.max, "highest"))
    return grouped.withColumn("pooled", ratio("numerator", "denominator"))


def truth_claims(truth: DataFrame, truth_links: DataFrame, batches: DataFrame) -> DataFrame:
    """What a matcher that knows the answer would claim: matchable credits whose payouts are all in the report."""
    have = truth_links.join(batches.select("merchant_id", "settlement_id", F.lit(1).alias("have")), ["merchant_id", "settlement_id"], "left")
    sets = have.groupBy(*CREDIT).agg(F.array_sort(F.collect_list("settlement_id")).alias("settlement_ids"), F.count_if(F.col("have").isNull()).alias("lacking"))
    return truth.filter("matchable").join(sets.filter("lacking = 0"), CREDIT).select(*CREDIT, "settlement_ids", F.lit("exact_utr").alias("strategy"), F.lit(1.0).alias("confidence"))


def set_relation(claims: DataFrame, truth_links: DataFrame) -> DataFrame:
    """For each claim whether its settlements equal the true ones, and what is missing or too much."""
    expected = truth_links.groupBy(*CREDIT).agg(F.array_sort(F.collect_list("settlement_id")).alias("expected"))
    j = claims.select(*CREDIT, F.array_sort("settlement_ids").alias("claimed")).join(expected, CREDIT, "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))
    return j.select(*CREDIT, (F.col("claimed") == F.col("expected")).alias("same"), (F.size(F.array_except("claimed", "expected")) == 0).alias("within"), F.size(F.array_except("expected", "claimed")).alias("missing"), F.size(F.array_except("claimed", "expected")).alias("extra"))
