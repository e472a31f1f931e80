"""One reconciliation of all merchants: rungs in order, each over what is left, then proofs and exceptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators.batches import CREDIT, rebuild
from ..operators.contract import rate_cards
from ..operators.proofs import prove
from ..operators.rungs import RUNGS
from ..sources.ledger import Ledger, load
from ..sources.session import cut, merged, stamp


def cascade(credits: DataFrame, batches: DataFrame, rates: DataFrame, rungs=RUNGS, anchored: bool = False) -> DataFrame:
    """The outcome of every credit. A rung sees the credits still open and the payouts unclaimed when it starts.

    anchored: rungs are told the outcome so far, so that a withdrawn claim narrows the search for sums.
    """
    return cascade_steps(credits, batches, rates, rungs, anchored)[-1]


def cascade_steps(credits: DataFrame, batches: DataFrame, rates: DataFrame, rungs=RUNGS, anchored: bool = False) -> list[DataFrame]:
    """The outcome of every credit after each rung: what a cascade of only so many rungs would give.

    A rung is written twice, as attempts and as outcomes; what is open follows from the outcomes.
    """
    steps = []
    open_credits, open_batches, outcome, done = credits, batches, None, []
    for rung in rungs:
        attempts = cut(rung(open_credits, open_batches, rates, outcome if anchored else None))
        after = cut(C.fold(outcome, C.demote_contested(C.veto(attempts, open_credits, batches))))
        done.append(after.filter("verdict = 'MATCHED'"))
        outcome = after.filter("verdict <> 'MATCHED'")
        matched = done[0]
        for part in done[1:]:
            matched = matched.unionByName(part)
        claimed = matched.select("merchant_id", F.explode("settlement_ids").alias("settlement_id"))
        open_credits = credits.join(merged(outcome.select(*CREDIT)), CREDIT, "left_semi")
        open_batches = batches.join(merged(claimed), ["merchant_id", "settlement_id"], "left_anti")
        steps.append(outcome.unionByName(matched))
    return steps


@dataclass(frozen=True)
class Run:
    """A reconciliation's tables. proofs: claims proved; shortfalls: claims that did not close; steps: the outcome after each rung."""

    ledger: Ledger
    batches: DataFrame
    rates: DataFrame
    outcome: DataFrame
    proofs: DataFrame
    shortfalls: DataFrame
    steps: tuple[DataFrame, ...] = ()


def reconcile(ledger: Ledger, rungs=RUNGS, rates: DataFrame | None = None, anchored: bool = False) -> Run:
    batches = cut(rebuild(ledger.rows))
    rates = cut(rates if rates is not None else rate_cards(ledger.rows))
    steps = cascade_steps(ledger.credits, batches, rates, rungs, anchored)
    return _run(ledger, batches, rates, cut(steps[-1]), tuple(steps))


def ablation(run: Run) -> list[Run]:
    """A run for each number of rungs, from the steps that the whole run took: no rung is tried again."""
    return [_run(run.ledger, run.batches, run.rates, cut(step)) for step in run.steps[:-1]] + [run]


def _run(ledger: Ledger, batches: DataFrame, rates: DataFrame, outcome: DataFrame, steps: tuple[DataFrame, ...] = ()) -> Run:
    proofs = cut(prove(outcome.filter("verdict = 'MATCHED'"), ledger.credits, batches).filter("proved"))
    withdrawn = outcome.filter("verdict <> 'MATCHED' AND size(withdrawn_ids) > 0").withColumn("settlement_ids", F.col("withdrawn_ids"))
    shortfalls = cut(prove(withdrawn, ledger.credits, batches).filter("NOT proved"))
    return Run(ledger, batches, rates, outcome, proofs, shortfalls, steps)


_runs: dict[tuple, Run] = {}


def run_of(spark: SparkSession, sf_dir: str, rungs=RUNGS) -> Run:
    """The run over a folder's derived ledger, kept for the session."""
    key = (spark.sparkContext.applicationId, *stamp(spark, f"{sf_dir}/orders.parquet"), tuple(r.__name__ for r in rungs))
    if key not in _runs:
        _runs[key] = reconcile(load(spark, sf_dir), rungs)
    return _runs[key]
