"""Reading a queue of exceptions as the few causes behind it.

Each rule puts a cause key on exceptions; a cause needs two of one key. Rules run
in order, each over what earlier ones left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GATEWAY_WORDS, payer_stem
from ..sources.session import cut
from .members import MOST_SHOWN, shown

LEAST = 2
BUCKET = "0.0002"


def _e(name: str) -> Column:
    return F.element_at("evidence", name)


def _counted_twice(queue: DataFrame) -> DataFrame:
    named = queue.select("merchant_id", F.explode(F.split(_e("settlements"), ", ")).alias("subject_id")).distinct().withColumn("named", F.lit("named"))
    return queue.join(named, ["merchant_id", "subject_id"], "left").withColumn("key", F.when(F.col("code") == "MISSING_SETTLEMENT", F.col("named"))).drop("named")


def _whole_run(queue: DataFrame) -> DataFrame:
    dated = (F.col("code") == "MISSING_SETTLEMENT") & _e("settled_on").isNotNull()
    missing = queue.filter(dated).withColumn("day", _e("settled_on"))
    that_day = _e("batches_that_day").cast("long")
    days = missing.groupBy("merchant_id", "day").agg(F.min(that_day).alias("low"), F.max(that_day).alias("high"), F.count(F.lit(1)).alias("n"))
    whole = days.filter("low = high AND n = low").select("merchant_id", "day", F.col("day").alias("key"))
    rest = queue.filter(~dated).withColumn("key", F.lit(None).cast("string"))
    return missing.join(whole, ["merchant_id", "day"], "left").select(*queue.columns, "key").unionByName(rest)


def _by(key: Column):
    return lambda queue: queue.withColumn("key", key)


def _code(code: str, key: Column) -> Column:
    return F.when(F.col("code") == code, key)


def _rate_bucket() -> Column:
    text = F.regexp_extract(_e("implied_rate"), r"^(\d+(?:\.\d+)?)%$", 1)
    return F.when(text != "", F.floor(text.try_cast("decimal(12,6)") / 100 / F.lit(BUCKET).cast("decimal(5,4)")).cast("string"))


def _payer() -> Column:
    stem = payer_stem(F.coalesce(_e("narration"), F.lit("")))
    theirs = (stem != "") & ~F.arrays_overlap(F.split(stem, " "), F.array(*[F.lit(w) for w in GATEWAY_WORDS]))
    return F.when((_e("reason") == "no candidate") & theirs, stem)


#: The causes in the order of their rules, the most specific first.
CAUSES = (
    "Payouts reported missing that a deposit here already accounts for",
    "A deduction that is not in the settlement report",
    "GST deducted at another rate than the report shows",
    "A whole payout run is missing",
    "Several deposits all fit one settlement",
    "Repeated deposits from one payer",
    "Refunds netted out of a later payout",
    "Payouts the gateway reported that never reached the bank",
    "Captured payments the settlement report never mentions",
)


def rules() -> list[tuple[str, object]]:
    """(cause, rule) in order."""
    found = [
        _counted_twice,
        _by(_code("FEE_DEDUCTION", _rate_bucket())),
        _by(_code("TAX_DEDUCTION", _e("rate_applied"))),
        _whole_run,
        _by(F.when(_e("reason") == "contested settlement", _e("settlement"))),
        _by(_payer()),
        _by(F.when((F.col("code") == "PARTIAL_PAYMENT") & _e("recovered_by").isNotNull(), F.lit("all"))),
        _by(_code("MISSING_SETTLEMENT", F.lit("all"))),
        _by(_code("UNSETTLED_PAYMENT", F.lit("all"))),
    ]
    return list(zip(CAUSES, found, strict=True))


def _split(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key has LEAST of them, and all others. Only rows with a key meet by it, and their groups are counted before the shuffle."""
    having = keyed.filter("key IS NOT NULL")
    large = having.groupBy("merchant_id", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST).select("merchant_id", "key")
    claimed = having.join(large, ["merchant_id", "key"], "left_semi")
    return claimed, keyed.filter("key IS NULL").unionByName(having.join(large, ["merchant_id", "key"], "left_anti"))


def one_rule(queue: DataFrame, no: int, most: int | None = MOST_SHOWN) -> DataFrame:
    """The causes that one rule finds in a whole queue."""
    claimed, _ = _split(rules()[no][1](queue))
    return _causes(claimed.withColumn("rule_no", F.lit(no + 1)).withColumnRenamed("key", "cause_key"), most)


CAUSE = ["merchant_id", "rule_no", "cause_key"]


def members(assigned: DataFrame) -> DataFrame:
    """Every exception of each cause, a row each."""
    return assigned.filter("rule_no IS NOT NULL").select(*CAUSE, "code", "subject_id", "amount")


def _causes(claimed: DataFrame, most: int | None) -> DataFrame:
    """Causes with their counts and the first of their members (most: how many, None for all); all members are a table of their own, too."""
    names = F.element_at(F.array(*[F.lit(name) for name, _ in rules()]), F.col("rule_no"))
    counts = claimed.groupBy(*CAUSE).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.abs("amount")).alias("total"),
        F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("codes"),
        F.count_distinct(_e("recovered_by")).alias("batches_elsewhere"),
        F.mode(_e("method"), True).alias("usual_method"),
    ).withColumn("cause", names)
    return counts.join(shown(claimed, CAUSE, "subject_id", "member_ids", most), CAUSE)


def assign(queue: DataFrame) -> DataFrame:
    """queue with rule_no and cause_key of the cause each exception belongs to, null where it is its own."""
    left, taken = queue, []
    for no in range(len(rules())):
        claimed, rest = _split(cut(rules()[no][1](left)))
        taken.append(claimed.withColumn("rule_no", F.lit(no + 1)).withColumnRenamed("key", "cause_key"))
        left = rest.select(*queue.columns)
    whole = left.withColumn("rule_no", F.lit(None).cast("int")).withColumn("cause_key", F.lit(None).cast("string"))
    for part in taken:
        whole = whole.unionByName(part)
    return whole


def induce(queue: DataFrame, most: int | None = MOST_SHOWN) -> DataFrame:
    """The causes of each merchant, ranked by money, then size, then name."""
    found = _causes(cut(assign(queue).filter("rule_no IS NOT NULL")), most)
    order = Window.partitionBy("merchant_id").orderBy(F.desc("total"), F.desc("members"), "cause", "cause_key")
    return found.withColumn("place", F.row_number().over(order))


def coverage(queue: DataFrame) -> DataFrame:
    """Of each merchant's exceptions, how many belong to a cause."""
    return assign(queue).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("exceptions"), F.count("rule_no").alias("caused"))
