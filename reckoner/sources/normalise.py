"""Cells with a mapping (file, field, col, pattern) to the engine's own tables; what cannot be read is dropped with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import parse_money
from ..functions.vocabulary import CARD_TYPE, ENTITY, METHOD, member_of, parse_bool, parse_temporal
from .statements import once

TEXT = lambda name: F.nullif(F.trim(F.col(name)), F.lit(""))


def mapped(cells: DataFrame, mapping: DataFrame | dict[str, str], fields: list[str]) -> DataFrame:
    """One row for each file and line with the mapped fields as text; an unmapped field is null.

    mapping: file, col, field; or, of a table whose columns are named, field and column.
    """
    if isinstance(mapping, dict):
        return cells.select("file", "line", once(*[(F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None).cast("string")).alias(f) for f in fields]))
    named = cells.join(mapping.select("file", "col", "field"), ["file", "col"])
    return named.groupBy("file", "line").pivot("field", fields).agg(F.first("value"))


def _date(name: str, pattern: str) -> Column:
    return parse_temporal(F.col(name), pattern).cast("date")


def bank_credits(wide: DataFrame, pattern: str) -> DataFrame:
    """Lines with a status: credit (with its id, counted over files in order), withdrawal, or dropped with a reason."""
    amount, debit = parse_money(F.col("amount")), parse_money(F.col("debit"))
    day = _date("value_date", pattern)
    empty = amount.isNull() | (amount == 0)
    status = F.when(empty & (F.coalesce(debit, F.lit(0)) != 0), "withdrawal").when(empty, "dropped").when(amount < 0, "withdrawal").when(day.isNull(), "dropped").otherwise("credit")
    reason = F.when((status == "dropped") & empty, "no credit amount on this line").when(status == "dropped", "unreadable date")
    rows = wide.select(*_whose(wide), "file", "line", status.alias("status"), reason.alias("reason"), amount.alias("amount"), day.alias("value_date"), F.trim("narration").alias("narration"), TEXT("utr").alias("utr"))
    return _numbered(rows)


def _whose(wide: DataFrame) -> list[str]:
    return ["merchant_id"] if "merchant_id" in wide.columns else []


def _numbered(rows: DataFrame) -> DataFrame:
    """Sequential ids over files and lines, for each merchant where rows name one: counts by file first, so that no task holds all rows."""
    is_credit = F.col("status") == "credit"
    per_file = rows.groupBy(*_whose(rows), "file").agg(F.count_if(is_credit).alias("n"))
    before = per_file.withColumn("before", F.sum("n").over(Window.partitionBy(*_whose(rows)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))).select("file", F.coalesce("before", F.lit(0)).alias("before"))
    place = F.sum(is_credit.cast("int")).over(Window.partitionBy("file").orderBy("line"))
    return rows.join(before, "file").withColumn("credit_id", F.when(is_credit, F.format_string("bank_%05d", F.col("before") + place))).drop("before")


def settlement_rows(wide: DataFrame, pattern: str, derive_sides: bool = False) -> DataFrame:
    """Report rows: kept, or dropped with a reason; sides read, or derived from a signed amount and the type."""
    kind, gross = member_of(F.col("type"), ENTITY), parse_money(F.col("amount"))
    created = _date("created_at", pattern)
    reason = F.when(TEXT("entity_id").isNull(), "no entity id").when(kind.isNull(), "unrecognised type").when(gross.isNull(), "unreadable amount").when(created.isNull(), "unreadable date")
    money = lambda name: F.coalesce(parse_money(F.col(name)), F.lit(0).cast("long"))
    debit, credit = sides(gross, kind) if derive_sides else (money("debit"), money("credit"))
    return wide.select(
        *_whose(wide), "file", "line", reason.alias("reason"), TEXT("entity_id").alias("entity_id"), kind.alias("type"), debit.alias("debit"), credit.alias("credit"), F.abs(gross).alias("amount"),
        money("fee").alias("fee"), money("tax").alias("tax"), F.coalesce(parse_bool(F.col("on_hold")), F.lit(False)).alias("on_hold"), F.coalesce(parse_bool(F.col("settled")), F.lit(True)).alias("settled"),
        created.alias("created_on"), _date("settled_at", pattern).alias("settled_on"), *[TEXT(c).alias(c) for c in ("settlement_id", "settlement_utr", "order_id", "payment_id")],
        member_of(F.col("method"), METHOD).alias("method"), member_of(F.col("card_type"), CARD_TYPE).alias("card_type"),
    )


def sides(gross: Column, kind: Column) -> tuple[Column, Column]:
    """Debit and credit of one signed amount: a minus is a debit; unsigned, the type decides."""
    zero = F.lit(0).cast("long")
    debit = F.when(gross < 0, -gross).when(kind == "payment", zero).otherwise(gross)
    credit = F.when((gross >= 0) & (kind == "payment"), gross).otherwise(zero)
    return debit, credit


def payments(wide: DataFrame, pattern: str) -> DataFrame:
    """Captures; an unknown method is a card, the slowest cycle."""
    amount, captured = parse_money(F.col("amount")), _date("captured_at", pattern)
    lacking = TEXT("payment_id").isNull() | TEXT("order_id").isNull() | amount.isNull() | captured.isNull()
    return wide.select(*_whose(wide), "file", "line", F.when(lacking, "missing an id, an amount or a date").alias("reason"), TEXT("payment_id").alias("payment_id"), TEXT("order_id").alias("order_id"), amount.alias("amount"), F.coalesce(member_of(F.col("method"), METHOD), F.lit("card")).alias("method"), member_of(F.col("card_type"), CARD_TYPE).alias("card_type"), captured.alias("captured_on"))


def orders(wide: DataFrame, pattern: str) -> DataFrame:
    amount, created = parse_money(F.col("amount")), _date("created_at", pattern)
    lacking = TEXT("order_id").isNull() | amount.isNull() | created.isNull()
    return wide.select(*_whose(wide), "file", "line", F.when(lacking, "missing an id, an amount or a date").alias("reason"), TEXT("order_id").alias("order_id"), F.coalesce(TEXT("order_receipt"), TEXT("order_id")).alias("order_receipt"), amount.alias("amount"), F.coalesce(TEXT("currency"), F.lit("INR")).alias("currency"), created.alias("created_on"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows kept and dropped of each kind, over all its files."""
    out = None
    for kind, df in tables.items():
        part = df.agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("dropped")).select(F.lit(kind).alias("kind"), "kept", "dropped")
        out = part if out is None else out.unionByName(part)
    return out
