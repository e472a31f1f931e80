"""Runs that are kept with digests of what they read: refused when stale, renewed only for merchants that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rungs import RUNGS
from ..sources.ledger import TABLES, Ledger
from ..sources.session import cut
from ..sources.store import fingerprint, save
from .reconcile import Run, reconcile


class StaleRun(ValueError):
    """What a kept run read is no longer what there is."""


def _tables(ledger: Ledger) -> dict[str, DataFrame]:
    return dict(zip(TABLES, (ledger.orders, ledger.payments, ledger.rows, ledger.credits)))


def digests(ledger: Ledger, rungs=RUNGS) -> DataFrame:
    """One row for each merchant and table: its rows, their digest, and the rungs that are to run over them."""
    out = None
    for name, df in _tables(ledger).items():
        part = fingerprint(df, TABLES[name].split(), ["merchant_id"]).select("merchant_id", F.lit(name).alias("name"), "n", "digest")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rungs", F.lit(" ".join(rung.__name__ for rung in rungs)))


def record(run: Run, folder: str, rungs=RUNGS) -> None:
    """Keeps a run's outcomes, and after them the digests of what it read: a folder that was cut off in between counts as stale."""
    save(run.outcome, f"{folder}/outcome")
    save(digests(run.ledger, rungs), f"{folder}/digests")


def changed_merchants(ledger: Ledger, folder: str, rungs=RUNGS) -> DataFrame:
    """Merchants of whom any table differs from what the kept run read, new and vanished ones too."""
    then = ledger.credits.sparkSession.read.parquet(f"{folder}/digests").select("merchant_id", "name", F.struct("n", "digest", "rungs").alias("then"))
    now = digests(ledger, rungs).select("merchant_id", "name", F.struct("n", "digest", "rungs").alias("now"))
    return now.join(then, ["merchant_id", "name"], "full").filter(~F.col("now").eqNullSafe(F.col("then"))).select("merchant_id").distinct()


def kept_outcome(ledger: Ledger, folder: str, rungs=RUNGS) -> DataFrame:
    """The outcomes of a kept run over just this ledger; a StaleRun error where it has changed."""
    if n := changed_merchants(ledger, folder, rungs).count():
        raise StaleRun(f"{folder}: {n} merchants are not as the run read them")
    return ledger.credits.sparkSession.read.parquet(f"{folder}/outcome")


def refresh(ledger: Ledger, folder: str, rungs=RUNGS, anchored: bool = False) -> DataFrame:
    """The outcome of every credit: kept ones for merchants that have not changed, new ones for the others, as in a full run."""
    changed = cut(changed_merchants(ledger, folder, rungs))
    kept = ledger.credits.sparkSession.read.parquet(f"{folder}/outcome").join(changed, "merchant_id", "left_anti")
    part = Ledger(*(df.join(changed, "merchant_id", "left_semi") for df in _tables(ledger).values()))
    return kept.unionByName(reconcile(part, rungs, anchored=anchored).outcome)
