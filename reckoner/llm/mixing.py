"""Mixing sources to target weights by soft membership.

A classifier fitted on labelled documents gives each document a posterior over
domains. With t_i the tokens and p_i the posteriors of document i, rates r_i >= 0
are fitted so that sum_i r_i t_i p_i comes as near as it can, in the least
squares sense, to the target tokens of each domain. The fit is projected
gradient descent from r = 1: every step is one distributed sum of the domain
totals, and each document moves by its own posteriors times the same few
numbers, and is cut at zero. The gradient is scaled by the inverse of
sum t_i p_i p_i' over documents not at zero, which makes a step without cuts
exact; with cuts it takes a few steps more, halved where one went too far. The
loop ends when no domain is further than TOLERANCE (a share of all tokens) from its
target or after STEPS; the residual it ends with is part of the fit, stands beside
every rate, and is warned of where it is over TOLERANCE. Rates become whole copies
by a hash of the row's id, right in mean.

Classifier: multinomial naive Bayes on words hashed to BUCKETS, its log odds
divided by the square root of the word count, so that long texts stay soft. It is
fitted on at most SAMPLE_DOCS labelled documents, in the order of a hash of their
id; posteriors, totals and rates cover every document.

Defined cases: null or empty text has no tokens, the prior as posterior and the
rate that follows from it; domains without labelled documents take no part, and
the targets of the others are taken in proportion; where none of these has a
target over 0, as with no labels at all, every rate is 1 and the residual null;
repeated rows each count; other columns stay (mix) or are ignored (rates).
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import cut, table, utf8, written

BUCKETS = 1 << 16
SAMPLE_DOCS = 20_000
TARGETS = {"good": 0.80, "plain": 0.15, "toxic": 0.05}
STEPS, TOLERANCE = 24, 1e-5
SMOOTHING = 0.05


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic, else good or plain by quality. Of several rows of a document the largest values count; documents without labels are left out."""
    toxic, quality = F.max("toxic"), F.max("quality")
    domain = F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "plain")
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(domain.alias("domain")).filter("domain IS NOT NULL")


def _buckets(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (BUCKETS - 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for domain, text in zip(batch.column("domain").to_pylist(), batch.column("text").to_pylist()):
            if domain not in totals:
                totals[domain], docs[domain] = np.zeros(BUCKETS, np.int64), 0
            totals[domain] += np.bincount(_buckets(text), minlength=BUCKETS)
            docs[domain] += 1
    for domain, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"domain": [domain] * (len(at) + 1), "bucket": [-1, *at.tolist()], "n": [docs[domain], *counts[at].tolist()]}, schema=pa.schema([("domain", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]))


class Classifier:
    """domains in order, prior log odds, log weights by bucket and domain."""

    def __init__(self, domains: list[str], prior: np.ndarray, weights: np.ndarray):
        self.domains, self.prior, self.weights = domains, prior, weights

    def predict(self, text: bytes) -> tuple[int, np.ndarray]:
        at = _buckets(text)
        if not self.domains:
            return len(at), self.prior
        logits = self.prior.copy()
        if len(at):
            logits += self.weights[at].sum(axis=0, dtype=np.float64) / np.sqrt(len(at))
        odds = np.exp(logits - logits.max())
        return len(at), odds / odds.sum()


def fit(docs: DataFrame, labelled: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Classifier:
    """labelled: doc_id and domain."""
    picked = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text")).join(F.broadcast(picked), "doc_id").select("domain", "text")
    found = rows.mapInArrow(_count_words, "domain string, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()
    domains = sorted(found["domain"].unique())
    counts, sizes = np.zeros((BUCKETS, len(domains))), np.zeros(len(domains))
    for d, domain in enumerate(domains):
        part = found[found["domain"] == domain]
        words = part[part["bucket"] >= 0]
        counts[words["bucket"].to_numpy(), d] = words["n"].to_numpy()
        sizes[d] = part[part["bucket"] < 0]["n"].sum()
    if not domains:
        return Classifier([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    weights = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BUCKETS)
    weights -= weights.mean(axis=1, keepdims=True)
    return Classifier(domains, np.log(sizes / sizes.sum()), weights.astype(np.float32))


MEMBERSHIP = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])


def membership(docs: DataFrame, model: Classifier, text_col: str = "text", out_col: str = "member") -> DataFrame:
    """docs with a struct of n_tokens and the posteriors in the model's order of domains."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(MEMBERSHIP)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shared.value.predict(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([n for n, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.float64()))],
                names=["n_tokens", "posterior"],
            )

    return docs.withColumn(out_col, predict(utf8(F.col(text_col))))


def _moved(rate: Column, posterior: Column, step: list[float]) -> Column:
    """max(0, rate - posterior . step)"""
    for d, x in enumerate(step):
        rate = rate - F.element_at(posterior, d + 1) * F.lit(float(x))
    return F.greatest(F.lit(0.0), rate)


@dataclass
class Fit:
    """The steps that lead from rate 1 to the fitted rates, and the largest difference of a domain's share from its target."""

    steps: list[list[float]]
    residual: float | None = None


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS) -> Fit:
    """members: n_tokens, posterior; targets: weights by domain."""
    k = len(targets)
    if not k or sum(targets) <= 0:
        return Fit([])
    p = [F.element_at("posterior", d + 1) for d in range(k)]
    t = F.col("n_tokens").cast("double")
    open_tokens = F.when(F.col("rate") > 0, t).otherwise(0.0)
    total = members.agg(F.sum(t)).first()[0]
    if not total:
        return Fit([])
    goal = np.array(targets) / sum(targets)
    state, taken, held, size = members.select("n_tokens", "posterior").withColumn("rate", F.lit(1.0)), [], np.inf, 1.0
    for n in range(steps + 1):
        sums = [F.sum(t * F.col("rate") * x).alias(f"d{i}") for i, x in enumerate(p)]
        sums += [F.sum(open_tokens * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        row = state.agg(*sums).first()
        residual = np.array([row[f"d{i}"] for i in range(k)]) / total - goal
        far = float(np.abs(residual).max())
        if far < TOLERANCE or n == steps:
            break
        size = size / 2 if far > held else min(1.0, 1.5 * size)
        held = far
        outer = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
        taken.append((size * np.linalg.solve(outer + 1e-6 * np.eye(k), residual)).tolist())
        state = state.withColumn("rate", _moved(F.col("rate"), F.col("posterior"), taken[-1]))
        if n % 8 == 7:
            state = cut(state)
    if far >= TOLERANCE:
        warnings.warn(f"rates fitted to within {far:.2g} of the targets only", stacklevel=2)
    return Fit(taken, far)


def rate_of(posterior: Column, taken: list[list[float]]) -> Column:
    rate = F.lit(1.0)
    for step in taken:
        rate = _moved(rate, posterior, step)
    return rate


def copies_of(rate: Column, id_col: Column) -> Column:
    """Whole copies, in the mean the rate."""
    part = (F.pmod(F.xxhash64(id_col, F.lit("mix")), F.lit(1_000_000)) + 0.5) / 1_000_000
    return F.floor(rate + part).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, a posterior p_<domain> for each target, rate, copies and the fit's residual for each row of docs."""
    model = fit(docs, label_domains(labels))
    members = cut(membership(docs.select("doc_id", "text"), model).select("doc_id", "member.n_tokens", "member.posterior"))
    fitted = fit_rates(members, [targets.get(d, 0.0) for d in model.domains])
    named = [(F.element_at("posterior", model.domains.index(d) + 1) if d in model.domains else F.lit(0.0)).alias(f"p_{d}") for d in sorted(targets)]
    found = members.withColumn("rate", rate_of(F.col("posterior"), fitted.steps))
    return found.select("doc_id", "n_tokens", *named, "rate", copies_of(F.col("rate"), F.col("doc_id")).alias("copies"), F.lit(fitted.residual).cast("double").alias("residual"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, each as often as its copies say. Posteriors are found once and kept beside the rows."""
    model = fit(docs, label_domains(labels))
    members = written(membership(docs, model, out_col="__member"), "members")
    fitted = fit_rates(members.select("__member.n_tokens", "__member.posterior"), [targets.get(d, 0.0) for d in model.domains])
    copies = copies_of(rate_of(F.col("__member.posterior"), fitted.steps), F.col("doc_id"))
    return members.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
