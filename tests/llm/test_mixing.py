import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from reckoner.llm import mixing as M

DIR = "/root/testdata/sf0.01"


def plain_rates(t, p, goal, steps=2000):
    """The same least squares by plain projected gradient, in numpy."""
    r = np.ones(len(t))
    total = t.sum()
    outer = (p * t[:, None]).T @ p / total
    weight = np.linalg.pinv(outer + 1e-9 * np.eye(p.shape[1]))
    for _ in range(steps):
        residual = (t * r) @ p / total - goal
        r = np.maximum(0, r - 0.5 * p @ (weight @ residual))
    return r, (t * r) @ p / total


def test_totals_meet_targets(spark):
    rows = M.op1_mixing(spark, DIR).toPandas()
    assert len(rows) == 1000 and (rows.rate >= 0).all()
    p = rows[["p_good", "p_plain", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    t = rows.n_tokens.to_numpy(float)
    got = (t * rows.rate.to_numpy()) @ p / t.sum()
    assert np.allclose(got, [0.80, 0.15, 0.05], atol=1e-3)
    assert abs((t * rows.copies).sum() / (t * rows.rate).sum() - 1) < 0.1


def test_as_near_as_plain_gradient(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    t = rng.integers(1, 200, 300)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "n_tokens long, posterior array<double>")
    for goal in ([0.6, 0.3, 0.1], [0.98, 0.01, 0.01]):
        fitted = M.fit_rates(members, goal, steps=24)
        taken = fitted.steps
        got = members.withColumn("rate", M.rate_of(F.col("posterior"), taken)).toPandas()
        x = got.n_tokens.to_numpy(float)
        q = np.stack(got.posterior)
        totals = (x * got.rate.to_numpy()) @ q / x.sum()
        _, want = plain_rates(x, q, np.array(goal))
        assert abs(fitted.residual - np.abs(totals - goal).max()) < 1e-9
        assert np.abs(totals - goal).max() <= np.abs(want - goal).max() + 1e-3


def test_separates_labelled_domains(spark):
    labels = M.label_domains(spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = M.op1_mixing(spark, DIR).join(labels, "doc_id").toPandas()
    for domain in ("good", "plain", "toxic"):
        inside = rows.domain == domain
        assert rows[inside][f"p_{domain}"].mean() > rows[~inside][f"p_{domain}"].mean() + 0.2


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "good fine words", 1.0), (4, "bad words here", 1.0), (4, "bad words here", 1.0), (5, "x " * 50_000, 1.0)], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (4, 1, 1), (9, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = M.rates(docs, labels).collect()
    assert len(got) == 6 and all(r.rate >= 0 for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[5] == 50_000
    assert all(r.rate == 1.0 for r in M.rates(docs, labels.limit(0)).collect())
    assert M.rates(docs.limit(0), labels).collect() == []
    mixed = M.mix(docs, labels)
    assert mixed.columns == docs.columns
    wanted = sum(r.copies for r in got)
    assert mixed.count() == wanted


def test_repeated_labels(spark):
    rows = [(1, 0, 0), (1, 1, 0), (2, 1, 0), (2, None, 1), (3, 0, None), (3, 0, 0), (4, None, None), (4, None, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in M.label_domains(labels).collect()} == {(1, "good"), (2, "toxic"), (3, "plain")}


def test_targets_without_domains(spark):
    """Targets of absent domains, or of nothing, leave every rate at 1; a target that can't be met is warned of."""
    docs = spark.createDataFrame([(1, "good fine words"), (2, "more good words"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for targets in ({"toxic": 1.0}, {"good": 0.0}, {}):
        rows = M.rates(docs, labels, targets).collect()
        assert [(r.rate, r.copies, r.residual) for r in rows] == [(1.0, 1, None)] * 3
    assert M.mix(docs, labels, {"toxic": 1.0}).count() == 3
    members = spark.createDataFrame([(10, [0.5, 0.5]), (10, [0.4, 0.6])], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="only"):
        assert M.fit_rates(members, [1.0, 0.0]).residual > 0.1


def test_posteriors_match_brute_force(spark):
    """Naive Bayes over the labelled documents, with dictionaries."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    domain = dict(M.label_domains(spark.read.parquet(f"{DIR}/labels.parquet")).collect())
    counts = {d: Counter() for d in sorted(set(domain.values()))}
    sizes = Counter()
    bucket = lambda w: zlib.crc32(w) % (1 << 16)
    for i, text in docs:
        if i in domain:
            counts[domain[i]].update(bucket(w) for w in text.encode().lower().split())
            sizes[domain[i]] += 1
    total = {d: c.total() + 0.05 * (1 << 16) for d, c in counts.items()}
    got = {r.doc_id: r for r in M.op1_mixing(spark, DIR).collect()}
    for i, text in docs[:60]:
        words = text.encode().lower().split()
        logits = {d: math.log(sizes[d] / sizes.total()) + sum(math.log((counts[d][bucket(w)] + 0.05) / total[d]) for w in words) / math.sqrt(max(1, len(words))) for d in counts}
        top = max(logits.values())
        odds = {d: math.exp(v - top) for d, v in logits.items()}
        assert got[i].n_tokens == len(words)
        assert all(abs(got[i][f"p_{d}"] - v / sum(odds.values())) < 1e-4 for d, v in odds.items())
