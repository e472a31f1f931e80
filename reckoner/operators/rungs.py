"""The matching rungs. Each takes credits and open batches and gives one attempt for each credit.

An attempt: strategy, verdict (MATCHED, AMBIGUOUS, NO_CANDIDATE), settlement_ids
of a match, candidates, confidence. A rung never picks among several fits. prior: the
outcome of earlier rungs, for those that make use of it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.rates import widest_deduction
from ..functions.text import extract_reference, narration_letters, reference_letters
from ..sources.session import cut, merged
from .batches import CREDIT

NEAR_DAYS = 1
MERGE_BEFORE, MERGE_AFTER = 3, 1
MOST_MEMBERS = 3
FLOOR, MARGIN = 0.78, 0.10
SCORED_FROM = 0.65  # below FLOOR - MARGIN a score decides nothing and counts as 0
LONGEST = 40  # references up to this length have a bound of their own
STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(STRINGS)


def _verdicts(credits: DataFrame, fits: DataFrame, strategy: str, confidence: Column, show: bool = True) -> DataFrame:
    """Attempts from fits (credit, settlement_id, and what confidence reads): one fit matches, several are ambiguous."""
    grouped = fits.groupBy(*CREDIT).agg(
        F.sort_array(F.collect_set("settlement_id")).alias("ids"),
        F.max(confidence).alias("sure"),
    )
    n = F.coalesce(F.size("ids"), F.lit(0))
    n = F.when(F.col("ids").isNull(), 0).otherwise(n)
    return credits.select(*CREDIT).join(grouped, CREDIT, "left").select(
        *CREDIT,
        F.lit(strategy).alias("strategy"),
        F.when(n == 0, "NO_CANDIDATE").when(n == 1, "MATCHED").otherwise("AMBIGUOUS").alias("verdict"),
        F.when(n == 1, F.col("ids")).otherwise(_none()).alias("settlement_ids"),
        F.coalesce("ids", _none()).alias("candidates"),
        F.when(n == 1, F.col("sure")).otherwise(F.lit(0.0)).alias("confidence"),
    )


def exact_reference(credits: DataFrame, batches: DataFrame, rates: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """The bank's reference, or one read from the narration, equals the payout's."""
    known = credits.select(*CREDIT, F.coalesce(F.when(F.col("utr") != "", F.col("utr")), extract_reference(F.col("narration"))).alias("settlement_utr"))
    fits = merged(known.filter("settlement_utr IS NOT NULL")).join(batches.select("merchant_id", "settlement_utr", "settlement_id"), ["merchant_id", "settlement_utr"])
    return _verdicts(credits, fits, "exact_utr", F.lit(1.0))


def _near(credits: DataFrame, batches: DataFrame, before: int, after: int) -> DataFrame:
    """Credits with the batches settled from `before` days earlier to `after` days later: an equi-join on the day."""
    days = F.explode(F.sequence(F.date_sub("value_date", before), F.date_add("value_date", after)))
    asked = credits.select(*CREDIT, F.col("amount"), "value_date", days.alias("settled_on"))
    open_ = batches.select("merchant_id", "settled_on", "settlement_id", "expected_net", "allowance")
    return merged(asked).join(open_, ["merchant_id", "settled_on"])


def amount_and_date(credits: DataFrame, batches: DataFrame, rates: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """Settled within a day and equal within the batch's allowance."""
    gap = F.abs(F.col("amount") - F.col("expected_net"))
    fits = _near(credits, batches, NEAR_DAYS, NEAR_DAYS).filter(gap <= F.col("allowance"))
    sure = F.when(gap == 0, F.lit(0.95)).otherwise(F.lit(0.80) - F.lit(0.10) * gap / F.col("allowance"))
    return _verdicts(credits, fits, "amount_date", sure)


def _pairs_of(held: DataFrame) -> DataFrame:
    """Two payouts of a merchant that a credit could cover together, the larger one first, with what they add up to: made once for all credits."""
    side = lambda n: held.select("merchant_id", *[F.col(c).alias(f"{c}_{n}") for c in ("settlement_id", "settled_on", "expected_net", "allowance")])
    window = MERGE_BEFORE + MERGE_AFTER
    days = F.explode(F.sequence(F.date_sub("settled_on_1", window), F.date_add("settled_on_1", window)))
    first = F.col("expected_net_1") > F.col("expected_net_2")
    same = (F.col("expected_net_1") == F.col("expected_net_2")) & (F.col("settlement_id_1") < F.col("settlement_id_2"))
    pairs = merged(side(1).withColumn("settled_on_2", days)).join(side(2), ["merchant_id", "settled_on_2"]).filter(first | same)
    return pairs.withColumn("net", F.col("expected_net_1") + F.col("expected_net_2")).withColumn("slack", F.col("allowance_1") + F.col("allowance_2"))


def _anchors(prior: DataFrame, batches: DataFrame) -> DataFrame:
    """The open payouts that a claim withdrawn earlier names for a credit."""
    named = prior.select(*CREDIT, F.explode("withdrawn_ids").alias("settlement_id"))
    return merged(named).join(batches.select("merchant_id", "settlement_id"), ["merchant_id", "settlement_id"]).groupBy(*CREDIT).agg(F.sort_array(F.collect_set("settlement_id")).alias("anchors"))


def subset_sum(credits: DataFrame, batches: DataFrame, rates: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """Two or three payouts of the days around add up to the credit, and nothing else does.

    Single fits compete too; a pool of one has nothing to combine. prior: the outcome so
    far; where a withdrawn claim names payouts that are still open, only what contains all
    of them is an answer, and a surer one.

    Met in the middle: what two payouts of a merchant add up to is listed once, by buckets
    of money as wide as the widest allowance of three; a credit looks up its amount, and its
    amount less each third payout, in three buckets. No pool is too large to be searched.
    """
    by_credit = Window.partitionBy(*CREDIT)
    near = _near(credits, batches, MERGE_BEFORE, MERGE_AFTER).filter((F.col("expected_net") > 0) & (F.col("expected_net") <= F.col("amount") + F.col("allowance")))
    pool = near.withColumn("pool", F.count(F.lit(1)).over(by_credit)).filter("pool > 1").drop("pool")
    pool = pool.join(_anchors(prior, batches), CREDIT, "left") if prior is not None else pool.withColumn("anchors", F.lit(None).cast(STRINGS))
    pool = cut(pool.withColumn("anchors", F.coalesce("anchors", _none())))

    held = pool.select("merchant_id", "settlement_id", "settled_on", "expected_net", "allowance").distinct()
    width = held.groupBy("merchant_id").agg((F.max("allowance") * MOST_MEMBERS + 1).alias("width"))
    listed = _pairs_of(held).join(width, "merchant_id").withColumn("bucket", F.floor(F.col("net") / F.col("width"))).drop("width")

    asked = ["amount", "value_date", "anchors"]
    third = pool.select(*CREDIT, *asked, *[F.col(c).alias(f"{c}_3") for c in ("settlement_id", "expected_net", "allowance")])
    alone = pool.select(*CREDIT, *asked).distinct().select("*", F.lit(None).cast("string").alias("settlement_id_3"), F.lit(0).cast("long").alias("expected_net_3"), F.lit(0).cast("long").alias("allowance_3"))
    rest = F.col("amount") - F.col("expected_net_3")
    lookups = third.unionByName(alone).join(width, "merchant_id").filter(rest + F.col("width") >= 2 * F.col("expected_net_3"))
    middle = F.floor(rest / F.col("width"))
    lookups = lookups.withColumn("bucket", F.explode(F.array(middle - 1, middle, middle + 1))).drop("width")

    met = lookups.join(merged(listed), ["merchant_id", "bucket"])
    for n in (1, 2):
        day, most = F.col(f"settled_on_{n}"), F.col("amount") + F.col(f"allowance_{n}")
        met = met.filter((day >= F.date_sub("value_date", MERGE_BEFORE)) & (day <= F.date_add("value_date", MERGE_AFTER)) & (F.col(f"expected_net_{n}") <= most))
    later = (F.col("expected_net_2") > F.col("expected_net_3")) | ((F.col("expected_net_2") == F.col("expected_net_3")) & (F.col("settlement_id_2") < F.col("settlement_id_3")))
    pair = F.array("settlement_id_1", "settlement_id_2")
    anchored = lambda ids: F.size(F.array_except("anchors", ids)) == 0
    fits_already = (F.abs(F.col("amount") - F.col("net")) <= F.col("slack")) & anchored(pair)
    ids = F.array_compact(F.array("settlement_id_1", "settlement_id_2", "settlement_id_3"))
    met = met.filter(F.abs(rest - F.col("net")) <= F.col("slack") + F.col("allowance_3")).filter(F.col("settlement_id_3").isNull() | (later & ~fits_already)).filter(anchored(ids))
    several = met.select(*CREDIT, "anchors", ids.alias("ids"), F.abs(rest - F.col("net")).alias("off"))
    off = F.abs(F.col("amount") - F.col("expected_net"))
    single = pool.filter((off <= F.col("allowance")) & ((F.size("anchors") == 0) | F.array_contains("anchors", F.col("settlement_id"))))
    found = several.unionByName(single.select(*CREDIT, "anchors", F.array("settlement_id").alias("ids"), off.alias("off")))
    every = F.concat(*(F.collect_set(F.get("ids", F.lit(k))) for k in range(MOST_MEMBERS)))
    grouped = found.groupBy(*CREDIT).agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.array_distinct(every)).alias("all_ids"),
        F.sort_array(F.first("ids")).alias("ids"),
        F.first("off").alias("off"),
        F.first(F.size("anchors") > 0).alias("anchored"),
    )
    n = F.coalesce("n", F.lit(0))
    sure = F.when(F.col("off") == 0, 0.75).otherwise(0.65) + F.when(F.col("anchored"), 0.15).otherwise(0.0) - F.lit(0.05) * (F.size("ids") - 2)
    return credits.select(*CREDIT).join(grouped, CREDIT, "left").select(
        *CREDIT,
        F.lit("subset_sum").alias("strategy"),
        F.when(n == 0, "NO_CANDIDATE").when(n == 1, "MATCHED").otherwise("AMBIGUOUS").alias("verdict"),
        F.when(n == 1, F.col("ids")).otherwise(_none()).alias("settlement_ids"),
        F.coalesce("all_ids", _none()).alias("candidates"),
        F.when(n == 1, sure).otherwise(F.lit(0.0)).alias("confidence"),
    )


def best_window_ratio(reference: str, text: str, floor: float = 0.0) -> float:
    """The best sequence ratio of a reference with a stretch of the text three characters longer; 0 if floor or less.

    Characters in common, kept while the stretch slides on, bound the ratio from
    above, so that few stretches are compared in full.
    """
    if not reference or not text:
        return 0.0
    size = len(reference)
    left, common = Counter(reference), 0  # what of the reference the stretch lacks; how many it has
    matcher, best, end = SequenceMatcher(a=reference, autojunk=False), floor, 0
    for start in range(len(text)):
        if start:
            left[text[start - 1]] += 1
            common -= left[text[start - 1]] > 0
        while end < min(len(text), start + size + 3):
            common += left[text[end]] > 0
            left[text[end]] -= 1
            end += 1
        if 2 * common / (size + end - start) > best:
            matcher.set_seq2(text[start:end])
            best = max(best, matcher.ratio())
    return best if best > floor else 0.0


@arrow_udf(T.DoubleType())
def similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for references, texts in batches:
        yield pa.array([best_window_ratio(a or "", b or "", SCORED_FROM) for a, b in zip(references.to_pylist(), texts.to_pylist())], pa.float64())


def least_shared(length: int, ratio: float) -> int:
    """How many adjacent pairs of a reference of this length stand in a stretch of text, at least, where their ratio reaches `ratio`.

    Of m characters that match in blocks, a reference of l and a stretch of w can have
    l + w - 2m + 1 blocks at most, and each block has a pair less than characters.
    """
    found = []
    for width in range(1, length + 4):
        matched = math.ceil(ratio * (length + width) / 2 - 1e-9)
        if matched <= min(length, width):
            found.append(max(0, 3 * matched - length - width - 1))
    return min(found, default=0)


def _bound(ratio: Column | float) -> Column:
    """least_shared of the reference's length, at a ratio given in whole hundredths from FLOOR - MARGIN up where it is a column."""
    ratios = [ratio] if isinstance(ratio, float) else [k / 100 for k in range(RATIO_FROM, 101)]
    table = F.split(F.lit(",".join(str(least_shared(n, r)) for r in ratios for n in range(LONGEST + 1))), ",")  # one literal: a thousand slow down every analysis
    row = F.lit(0) if isinstance(ratio, float) else ratio - RATIO_FROM
    return F.get(table, row * (LONGEST + 1) + F.least(F.length("reference"), F.lit(LONGEST))).cast("int")


RATIO_FROM = round(100 * (FLOOR - MARGIN))


def _pairs_in(text: Column) -> Column:
    """Adjacent pairs of characters, repeats included."""
    return F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(_none())


def no_pair_up_to(ratio: float) -> int:
    """The longest reference that can reach the ratio without sharing an adjacent pair; all shorter ones can, too."""
    return max(n for n in range(1, LONGEST + 1) if least_shared(n, ratio) == 0)


def _sharing(said: DataFrame, open_: DataFrame, bound: Column, free: Column) -> DataFrame:
    """Credits with the references that have as many pairs in common with what is said as the bound takes.

    An equi-join on merchant and pair. References of up to `free` letters, which need no
    pair, are met by their length (a mark and the number); those of one letter only where
    it is the last one said, for any longer stretch is too long for it.
    """
    lengths = F.when(free > 1, F.transform(F.sequence(F.lit(2), free), lambda n: F.concat(F.lit("#"), n.cast("string")))).otherwise(_none())
    last = F.array(F.concat(F.lit("$"), F.right(F.col("said"), F.lit(1))))
    asked = said.withColumn("pair", F.explode(F.concat(F.array_distinct(_pairs_in(F.col("said"))), lengths, last)))
    size = F.length("reference")
    kind = F.when(size == 1, F.array(F.concat(F.lit("$"), F.col("reference")))).when(size <= no_pair_up_to(RATIO_FROM / 100), F.array(F.concat(F.lit("#"), size.cast("string")))).otherwise(_none())
    held = open_.withColumn("pair", F.explode(F.concat(_pairs_in(F.col("reference")), kind)))
    keys = [*CREDIT, "settlement_id", "said", "reference", *(c for c in said.columns if c not in (*CREDIT, "said"))]
    met = merged(asked).join(held, ["merchant_id", "pair"]).groupBy(*keys).agg(F.count_if(~F.substring("pair", 1, 1).isin("#", "$")).alias("shared"))
    return met.filter(F.col("shared") >= bound).select(*keys)


#: Not marked so, the filter on the score would go below the count of shared pairs and score every pair that shares one.
_similarity_in_place = similarity.asNondeterministic()


def _scored(pairs: DataFrame) -> DataFrame:
    """Pairs that score at all. Few bytes of rows take much work, so they are dealt to as many tasks as a shuffle has."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, *CREDIT, "settlement_id").withColumn("score", _similarity_in_place("reference", "said")).filter("score > 0")


def fuzzy_scores(credits: DataFrame, batches: DataFrame) -> DataFrame:
    """Best score of each credit that some reference resembles, and the second where it is less than MARGIN behind, else 0.

    Winners are looked for among references that share so many adjacent pairs with
    the narration as a ratio of FLOOR takes. A winner of FLOOR + MARGIN or more has its
    runner-up among the same ones. For lower winners it is looked for among those that
    share what a ratio of the winner's score less MARGIN takes. Only references so short
    that no pair is needed (three letters at FLOOR, seven at 0.72) are met by length.
    """
    said = credits.select(*CREDIT, narration_letters(F.col("narration")).alias("said")).filter("said <> ''")
    open_ = batches.filter("settlement_utr <> ''").select("merchant_id", "settlement_id", reference_letters(F.col("settlement_utr")).alias("reference")).filter("reference <> ''")
    near = cut(_scored(_sharing(said, open_, _bound(FLOOR), F.lit(no_pair_up_to(FLOOR)))).select(*CREDIT, "said", "settlement_id", "score"))
    best = near.groupBy(*CREDIT, "said").agg(F.max("score").alias("best")).filter(F.col("best") >= FLOOR)
    high = F.col("best") >= FLOOR + MARGIN
    asked = best.filter(~high).withColumn("hundredths", F.floor((F.col("best") - MARGIN) * 100 + 1e-9).cast("int"))
    free = F.get(F.array(*(F.lit(no_pair_up_to(k / 100)) for k in range(RATIO_FROM, 101))), F.col("hundredths") - RATIO_FROM)
    rivals = _scored(_sharing(asked, open_, _bound(F.col("hundredths")), free))
    kept = [*CREDIT, "settlement_id", "score", "best"]
    scored = merged(near).join(best.filter(high).drop("said"), CREDIT).select(*kept).unionByName(rivals.select(*kept)).filter(F.col("best") - F.col("score") < MARGIN)
    order = Window.partitionBy(*CREDIT).orderBy(F.desc("score"), "settlement_id")
    return (
        scored.withColumn("place", F.row_number().over(order))
        .filter("place <= 2")
        .withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
        .withColumn("second_id", F.lead("settlement_id").over(order))
        .filter("place = 1")
        .select(*CREDIT, "settlement_id", "score", "second", "second_id")
    )


def fuzzy_narration(credits: DataFrame, batches: DataFrame, rates: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """A damaged reference resembles one payout's, and clearly more than any other's."""
    best = fuzzy_scores(credits, batches).filter(F.col("score") >= FLOOR)
    clear = F.col("score") - F.col("second") >= MARGIN
    return credits.select(*CREDIT).join(best, CREDIT, "left").select(
        *CREDIT,
        F.lit("fuzzy_narration").alias("strategy"),
        F.when(F.col("score").isNull(), "NO_CANDIDATE").when(clear, "MATCHED").otherwise("AMBIGUOUS").alias("verdict"),
        F.when(clear, F.array("settlement_id")).otherwise(_none()).alias("settlement_ids"),
        F.when(F.col("score").isNull(), _none()).when(clear, F.array("settlement_id")).otherwise(F.array_compact(F.array("settlement_id", "second_id"))).alias("candidates"),
        F.when(clear, F.least(F.lit(0.70), F.lit(0.40) + F.lit(0.35) * F.col("score"))).otherwise(F.lit(0.0)).alias("confidence"),
    )


def shortfall(credits: DataFrame, batches: DataFrame, rates: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Settled within a day and larger than the credit by no more than a fee stack can take."""
    bands = rates.select("merchant_id", widest_deduction().alias("band"))
    gap = F.col("expected_net") - F.col("amount")
    fits = _near(credits, batches, NEAR_DAYS, NEAR_DAYS).join(bands, "merchant_id")
    fits = fits.filter((gap > F.col("allowance")) & (gap <= F.col("expected_net") * F.col("band")))
    return _verdicts(credits, fits, "shortfall", F.lit(0.35))


RUNGS = (exact_reference, amount_and_date, subset_sum, fuzzy_narration, shortfall)
#: The rungs without the similarity of damaged references.
PLAIN_RUNGS = (exact_reference, amount_and_date, subset_sum, shortfall)
