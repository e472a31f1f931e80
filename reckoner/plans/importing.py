"""From a folder of text files to the tables of a run: a plan (file, kind, field, column, date pattern) made from the files and applied to them as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import ISO, parse_temporal
from ..operators import profiling as P
from ..sources import normalise as N
from ..sources.fields import FIELDS, field_rows, field_table
from ..sources.ledger import Ledger, given
from ..sources.session import cut
from ..sources.statements import named_cells, once, read_rows

NEEDED = ("settlement_rows", "bank_credits")  # kinds without which there is nothing to reconcile


@dataclass(frozen=True)
class Imported:
    """ledger: of the merchants without a blocking limitation. plan: file, kind, field, col, pattern. counts: rows kept and dropped of each merchant and kind."""

    ledger: Ledger
    plan: DataFrame
    counts: DataFrame
    limitations: DataFrame


def _seen(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """P.seen_in of rows and their headers: counted by place, named afterwards."""
    placed = rows.select("file", "line", F.posexplode("values").alias("col", "value"))
    seen = P.seen_in(placed).withColumnRenamed("col", "place")
    names = heads.select("file", F.posexplode("names").alias("place", "col"))
    named = seen.join(names, ["file", "place"])
    sums = [c for c in seen.columns if c not in ("file", "place", "value", "line")]
    return named.groupBy("file", "col", "value").agg(F.min("line").alias("line"), *[F.sum(c).alias(c) for c in sums])


def plan_of(rows: DataFrame, heads: DataFrame, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan, and each field's state (found, open, absent) for each file of a known kind.

    answers: file, kind, field, col where a person has said so; they come before what the
    files' headers and values say. Two columns of one name or one column for two fields are
    left open. A date's pattern is the one that reads its column; where several do and
    disagree about a value, there is none.
    """
    fields = F.broadcast(field_table(rows.sparkSession))
    seen = cut(_seen(rows, heads))
    dated = cut(P.dates_in(seen))
    fitting = cut(P.fitting(named_cells(rows, heads), seen, dated))
    placed = P.identify(P.rank_kinds(fitting, fields)).select("file", "kind")
    if answers is not None:
        told = answers.select("file", F.col("kind").alias("told")).distinct()
        placed = seen.select("file").distinct().join(placed, "file", "left").join(told, "file", "left").select("file", F.coalesce("told", "kind").alias("kind"))
    states = cut(P.columns_of_fields(fitting, fields, placed))
    if answers is not None:
        said = answers.select("file", "kind", "field", F.col("col").alias("said"))
        states = states.join(said, ["file", "kind", "field"], "left").select("file", "kind", "field", "required", F.coalesce("said", "col").alias("col"), F.when(F.col("said").isNotNull(), "found").otherwise(F.col("state")).alias("state"))
        taken = states.filter("state = 'found'").join(said, ["file", "kind", "field"], "left").groupBy("file", "col").agg(F.count("said").alias("answered"), F.count(F.lit(1)).alias("claims"))
    else:
        taken = states.filter("state = 'found'").groupBy("file", "col").agg(F.lit(0).alias("answered"), F.count(F.lit(1)).alias("claims"))
    twice = taken.filter("claims > 1 AND answered < claims").select("file", "col", F.lit(True).alias("twice"))
    states = cut(states.join(twice, ["file", "col"], "left").select("file", "kind", "field", "required", "col", F.when(F.col("twice"), "open").otherwise(F.col("state")).alias("state")))
    times = F.broadcast(rows.sparkSession.createDataFrame([(k, f) for k, of in FIELDS.items() for f, value, _ in of if value == "temporal"], "kind string, field string")).withColumn("temporal", F.lit(True))
    pattern = F.when(F.col("conflict").isNull(), F.get("patterns", F.lit(0)))
    plan = states.filter("state = 'found'").join(times, ["kind", "field"], "left").join(dated, ["file", "col"], "left")
    plan = cut(plan.select("file", "kind", "field", "col", F.when(F.col("temporal"), pattern).alias("pattern"), F.coalesce("temporal", F.lit(False)).alias("temporal")))
    return plan, states


def layouts(plan: DataFrame, heads: DataFrame) -> DataFrame:
    """One row for each file and kind of the plan: where each field stands in a row (place, pattern, temporal), null if nowhere."""
    placed = heads.select("file", F.posexplode("names").alias("place", "col"))
    found = plan.join(placed, ["file", "col"])
    names = list(dict.fromkeys(f for of in FIELDS.values() for f, *_ in of))
    return found.groupBy("file", "kind").agg(*[F.min(F.when(F.col("field") == f, F.struct("place", "pattern", "temporal"))).alias(f) for f in names])


def _dated(value: Column, at: Column, used: list[str]) -> Column:
    """A date read under its column's pattern and written in ISO form; empty where there is none."""
    read = F.lit("")
    for p in used:
        read = F.when(at["pattern"] == p, F.coalesce(parse_temporal(value, p).cast("date").cast("string"), F.lit(""))).otherwise(read)
    return F.when(at["temporal"], read).otherwise(value)


def import_folder(lines: DataFrame, files: DataFrame, answers: DataFrame | None = None, delimiter: str = ",") -> Imported:
    """lines: file, line, text of all files; files: file, merchant_id.

    Files of one kind and merchant are stacked, bank credits numbered over them. A merchant
    that lacks a needed kind, or a required field of a file, is listed and left out.
    """
    rows, heads = read_rows(lines, delimiter)
    rows = cut(rows)
    plan, states = plan_of(rows, heads, answers)
    layout = cut(layouts(plan, heads))
    used = [r["pattern"] for r in plan.select("pattern").distinct().collect() if r["pattern"]]  # of the fixed list of patterns
    owner = files.select("file", "merchant_id")

    def wide(kind: str) -> DataFrame:
        fields = [(f, value == "temporal") for f, value, _ in FIELDS[kind]]
        own = layout.filter(F.col("kind") == kind).select("file", *[F.col(f).alias(f"_{f}") for f, _ in fields]).join(owner, "file")
        at = {f: F.col(f"_{f}") for f, _ in fields}
        found = {f: F.get("values", at[f]["place"]) for f, _ in fields}
        return rows.join(own, "file").select("file", "line", "merchant_id", once(*[(_dated(found[f], at[f], used) if temporal else found[f]).alias(f) for f, temporal in fields]))

    tables = {
        "orders": N.orders(wide("orders"), ISO),
        "payments": N.payments(wide("payments"), ISO),
        "settlement_rows": N.settlement_rows(wide("settlement_rows"), ISO),
        "bank_credits": N.bank_credits(wide("bank_credits"), ISO),
    }
    tables = {kind: cut(df) for kind, df in tables.items()}
    counts = None
    for kind, df in tables.items():
        part = df.groupBy("merchant_id").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("dropped")).select("merchant_id", F.lit(kind).alias("kind"), "kept", "dropped")
        counts = part if counts is None else counts.unionByName(part)

    kinds = rows.sparkSession.createDataFrame([(k, k in NEEDED) for k in sorted({k for k, *_ in field_rows()})], "kind string, blocking boolean")
    there = plan.select("file", "kind").distinct().join(owner, "file").select("merchant_id", "kind").distinct()
    missing = owner.select("merchant_id").distinct().crossJoin(F.broadcast(kinds)).join(there, ["merchant_id", "kind"], "left_anti")  # four kinds
    lacking = states.filter("state <> 'found'").join(owner, "file").select("merchant_id", "file", "kind", "field", "state", F.col("required").alias("blocking"))
    undated = plan.filter("temporal AND pattern IS NULL").join(owner, "file").select("merchant_id", "file", "kind", "field", F.lit("no certain date pattern").alias("state"), F.lit(False).alias("blocking"))
    unread = owner.join(rows.select("file").distinct(), "file", "left_anti").select("merchant_id", "file", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit("unreadable file").alias("state"), F.lit(False).alias("blocking"))
    none = F.lit(None).cast("string")
    limits = missing.select("merchant_id", none.alias("file"), "kind", none.alias("field"), F.lit("missing kind").alias("state"), "blocking")
    limits = cut(limits.unionByName(lacking).unionByName(undated).unionByName(unread))
    blocked = limits.filter("blocking").select("merchant_id").distinct()
    fine = {kind: df.filter("reason IS NULL").join(blocked, "merchant_id", "left_anti").drop("reason") for kind, df in tables.items()}
    fine["bank_credits"] = fine["bank_credits"].filter("status = 'credit'").drop("status")
    return Imported(given(fine), plan, counts, limits)
