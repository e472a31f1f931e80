import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from reckoner.llm import lm as L


def tokens(text):
    return [*re.findall(rb"[^ \t-\r]+", (text or "").encode().lower()), b" "]


def brute(rows):
    counts = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(text))
    total, words = sum(counts.values()), len(counts)
    out = {}
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (words + 1))) for t in own)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(counts[t] > 0 for t in own), total, base)
    return out


@pytest.mark.parametrize("head", [L.HEAD, 50])
def test_base_is_exact_and_model_is_better(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in L.op5_lm_scoring(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


MASK = 2**64 - 1


def plain_hash(word):
    """The hash of a lower-case word, in integers."""
    if word == b" ":
        return L.END
    h = 0
    for i, byte in enumerate(word):
        h = (h + int(L._RANDOM[byte]) * pow(0x9E3779B97F4A7C15, i, 2**64)) & MASK
    for _ in range(2):
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & MASK
    return h ^ h >> 32


def plain_mix(h):
    for _ in range(2):
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & MASK
    return h ^ h >> 32


def plain_model(train, scored):
    """Scores by the docstring, token by token, with dictionaries and float64."""

    def steps(text):
        one = two = None
        for word in tokens(text):
            h = plain_hash(word)
            c, slot = h & 15, h >> 4 & 15
            b1 = None if one is None else one >> 20
            b2 = None if two is None else two >> 20
            both = plain_mix(((one or 0) * 3 + (two or 0)) & MASK) >> 20
            of_class = [("1", b1 if b1 is None else b1 % 4096), ("2", b2 if b2 is None else b2 % 2048), ("12", both % 8192)]
            of_slot = [("s1", b1 if b1 is None else b1 % 1024, c), ("s2", b2 if b2 is None else b2 % 512, c)]
            yield word, c, slot, of_class, of_slot
            one, two = h, one

    seen = [s for text in train for s in steps(text)]
    counts = Counter(s[0] for s in seen)
    observed, classes, slots = Counter(), Counter(), Counter()
    for _, c, slot, of_class, of_slot in seen:
        classes[c] += 1
        slots[c, slot] += 1
        observed.update([*((f, c) for f in of_class), *((f, slot) for f in of_slot)])
    class_share = [(classes[c] + 1) / (classes.total() + 16) for c in range(16)]
    slot_share = {(c, k): (slots[c, k] + 1) / (classes[c] + 16) for c in range(16) for k in range(16)}
    meets = Counter()
    for (f, _), n in observed.items():
        meets[f] += n
    share = lambda f, o: slot_share[f[2], o] if len(f) == 3 else class_share[o]
    weights = {}

    def weight(f, o):
        if (f, o) not in weights:
            weights[f, o] = 0.6 * math.log((observed[f, o] + 20 * share(f, o)) / (meets[f] + 20) / share(f, o))
        return weights[f, o]

    def odds(features, prior):
        logits = [math.log(prior(o)) + sum(weight(f, o) for f in features) for o in range(16)]
        top = max(logits)
        total = math.log(sum(math.exp(x - top) for x in logits)) + top
        return [x - total for x in logits]

    expected = Counter()
    for _, c, _, of_class, of_slot in seen:
        for features, prior in ((of_class, lambda o: class_share[o]), (of_slot, lambda o: slot_share[c, o])):
            for o, x in enumerate(odds(features, prior)):
                for f in features:
                    expected[f, o] += math.exp(x)
    moved = {key: weight(*key) + (observed[key] - e) / (observed[key] + e + 20) for key, e in expected.items()}
    weights |= moved
    words_of, size_of = Counter(), Counter()
    for word, n in counts.items():
        h = plain_hash(word)
        words_of[h & 15, h >> 4 & 15] += 1
        size_of[h & 15, h >> 4 & 15] += n
    out = []
    for text in scored:
        total = 0.0
        for word, c, slot, of_class, of_slot in steps(text):
            total += (odds(of_class, lambda o: class_share[o])[c] + odds(of_slot, lambda o: slot_share[c, o])[slot]) / math.log(10)
            total += math.log10((counts[word] + 0.1) / (size_of[c, slot] + 0.1 * (words_of[c, slot] + 1)))
        out.append(total)
    return out


def test_score_matches_brute_force_under_any_partitioning(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    train, scored = [t[:1500] for t in texts[:40]], [*(t[:600] for t in texts[40:55]), "", None, "Only\x0bunseen zzzz"]
    want = plain_model(train, scored)
    docs = spark.createDataFrame(list(enumerate(scored)), "doc_id long, text string")
    learned = spark.createDataFrame([(t,) for t in train], "text string")
    found = [{r.doc_id: r.score for r in L.score(docs.repartition(n), learned.repartition(n)).collect()} for n in (1, 5)]
    assert found[0] == found[1]
    for i, score in enumerate(want):
        assert found[0][i] == pytest.approx(score, rel=1e-3, abs=1e-3)


def test_probabilities_sum_to_one():
    block = L.Block([b"a b C a", b"", b"  x  "])
    assert block.sizes.tolist() == [5, 1, 2]
    assert [h == L.END for h in block.hash.tolist()] == [False] * 4 + [True, True, False, True]
    assert [int(h) for h in block.hash[:3]] == [plain_hash(w) for w in (b"a", b"b", b"c")]
    rng = np.random.default_rng(0)
    prior = np.log(np.full((16, 16), 1 / 16, np.float32))
    model = L.Model(rng.normal(size=(L.OUT, int(L.AT[-1]))).astype(np.float32), prior[0], prior)
    for factor in model.log_odds(block.rows(), block.outcomes()[0]):
        assert np.allclose(np.exp(factor).sum(axis=0), 1, atol=1e-5)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c d e f"), (None, "a"), (None, "b b"), (2, "c")], "doc_id long, text string")
    rows = L.score(docs, docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (0, 3), (1, 4), (1, 7), (2, 2)]


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "A a\x0bA", 0.0), (4, "w " * 100_000, 0.0), (5, "A a a", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in L.score(docs, docs).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {1: 1, 2: 1, 3: 4, 4: 100_001, 5: 4}
    assert got[3].base_score == pytest.approx(got[5].base_score)
    got = L.score(docs, docs.limit(0)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(0) for r in got)
    assert L.score(docs.limit(0), docs).collect() == []
