"""Keeping a run's tables, and telling whether inputs are still the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str) -> None:
    """A report table as Parquet, in files that each hold whole ranges of merchants in order, so that a reader of one skips the others."""
    df.repartitionByRange("merchant_id", F.xxhash64(*df.columns)).sortWithinPartitions("merchant_id").write.mode("overwrite").parquet(path)


def save_ledger(ledger, folder: str) -> None:
    """The four tables of a ledger, for sources.ledger.read."""
    for name, df in (("orders", ledger.orders), ("payments", ledger.payments), ("settlement_rows", ledger.rows), ("bank_credits", ledger.credits)):
        save(df, f"{folder}/{name}.parquet")


def fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Row count and a digest that no order of rows changes: the sum of 48 bits of each row's hash, modulo 2^62.

    Each value is hashed with its length before it, so that nulls, empty texts and
    texts that run on into the next column differ.
    """
    text = lambda c: F.col(c).cast("string")
    whole = F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])
    bits = F.conv(F.substring(F.md5(whole.cast("binary")), 1, 12), 16, 10).cast("long")
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), (F.sum(bits.cast("decimal(20,0)")) % F.lit(1 << 62)).cast("long").alias("digest"))


def unchanged(df: DataFrame, columns: list[str], recorded: DataFrame) -> bool:
    """Whether a table still has the recorded fingerprint (one row)."""
    now, then = fingerprint(df, columns).first(), recorded.first()
    return (now.n, now.digest) == (then.n, then.digest)
