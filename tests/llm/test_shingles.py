from itertools import combinations

import corpus_pipeline as C
import numpy as np
import pytest
from pyspark.sql import functions as F
from reckoner.llm import shingles as S
from reckoner.llm import simhash


def grams(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(seed=5, bases=30, copies=4, size=120, most=4):
    """Texts and copies with one word to `most` words changed."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(bases):
        base = list(rng.choice(words, size))
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for at in rng.integers(0, size, int(rng.integers(1, most + 1))):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("words, similarity", [(5, 0.8), (3, 0.7)])
def test_pairs_match_brute_force(spark, words, similarity):
    texts = [*edited(), "a b c", "A  b c", "a b c d", "", " \n"]
    sets = [grams(t, words) for t in texts]
    want = {frozenset((texts[i], texts[j])) for i, j in combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= similarity}
    rows = spark.createDataFrame([(t.encode(),) for t in [*texts, texts[0]]], "text binary").select(S.node(F.col("text")).alias("node"), "text")
    name = {r.node: r.text.decode() for r in rows.collect()}
    got = [frozenset((name[r.a], name[r.b])) for r in S.similar(rows, words, similarity).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_a_crowd_is_connected(spark):
    texts = edited(bases=1, copies=200, size=400, most=8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs, words=5).collect()} == {0}


def test_stars_connect_what_pairs_connect(spark):
    """One row a text at most where pairs are many; the same parts."""
    rows = spark.createDataFrame([(t.encode(),) for t in [*edited(), *edited(bases=1, copies=60, size=400, most=4)]], "text binary").select(S.node(F.col("text")).alias("node"), "text")

    def parts(pairs):
        found = simhash.components(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).collect()
        return {(r.u, r.v) for r in found}

    pairs, stars = S.similar(rows).cache(), S.connecting(rows).cache()
    assert parts(stars) == parts(pairs) and stars.count() < rows.count() < pairs.count()


@pytest.mark.parametrize("leads", [S.LEADS, 1])
def test_no_link_of_a_crowd_is_lost(spark, monkeypatch, leads):
    """Meetings beyond CROWD: chains of edits, where centres and neighbours by size don't reach all, and passages that all texts hold."""
    monkeypatch.setattr(S, "CROWD", 6)
    monkeypatch.setattr(S, "CELL", 8)
    monkeypatch.setattr(S, "LEADS", leads)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(words, 60))
    texts = []
    for _ in range(12):
        now = [*passage, *rng.choice(words, 60)]
        for _ in range(8):
            texts.append(" ".join(now))
            now = list(now)
            for at in rng.integers(0, 120, 2):
                now[at] = str(rng.choice(words))
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=5).collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert 12 <= len(set(got.values())) < len(texts)


def test_stage_drops_edited_copies(spark):
    """No pair of similarity 0.8 stays in the stage's output, where SimHash alone leaves most."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(edited())], "doc_id long, text string, lang string, source string, n_chars long")
    left = [grams(r.text) for r in C.near_dedup(spark, docs, "").collect()]
    assert len(left) >= 30 and all(jaccard(a, b) < 0.8 for a, b in combinations(left, 2))
    alone = [grams(r.text) for r in docs.join(simhash.near_duplicates(docs).filter("kept").select("doc_id"), "doc_id").collect()]
    assert sum(jaccard(a, b) >= 0.8 for a, b in combinations(alone, 2)) > 10


def test_sketches_never_overstate(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 64, 65, 700):
        x = rng.integers(-(2**63), 2**63, n)
        y = np.concatenate([x[: n // 2], rng.integers(-(2**63), 2**63, n)])
        assert S.apart(S.sketch(x), S.sketch(y)) <= len(set(x) ^ set(y)) and S.apart(S.sketch(x), S.sketch(x)) == 0
