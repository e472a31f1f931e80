import re
from collections import Counter

import numpy as np
from reckoner.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(texts):
    """{lang: {words of a phrase: count}} of all phrases of up to four words."""
    out = {}
    for lang, text in texts:
        f = out.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for m in range(1, 5):
                f.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return out


def brute(texts, least=P.LEAST, top=P.TOP):
    out = []
    for lang, f in counts(texts).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and p[i:j] in found and 100 * a >= P.COVERED * found[p[i:j]]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n, -score) for k, (score, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    words = ["the", "of", "The", "a", "é", "b\x1c", "c\x00", "d"]
    texts = [("en", " ".join(rng.choice(words + [".", "\n", "x,y", "\t"], int(rng.integers(0, 60))))) for _ in range(150)]
    texts += [("en", "always the same few words")] * 40 + [(None, "a a a a a a a a"), ("und", "a a a! a a"), ("fr", None), ("fr", ""), ("de", "of the. " * 500), ("en", "q " * 30_000)]
    docs = spark.createDataFrame([(k, t, lang, 1) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, n int").repartition(3)
    want = brute(texts)
    assert len(want) > 30
    for shard_words in (P.SHARD_WORDS, 400):
        assert sorted(map(tuple, P.collocations(docs, shard_words=shard_words).collect())) == want
    assert sorted(map(tuple, P.collocations(docs, least=3, top=5).collect())) == brute(texts, 3, 5)


def test_no_rows(spark):
    assert P.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert P.collocations(spark.createDataFrame([(None, None), ("", "en"), (" . ", "en")], "text string, lang string")).collect() == []


def test_large_counts(spark):
    """Products pass 64 bits."""
    f = spark.createDataFrame([("en", "a", 1, 2 * 10**13), ("en", "b", 1, 10**13 + 1), ("en", "a b", 2, 10**13)], "lang string, phrase string, words int, f long")
    from unittest import mock

    shards = spark.createDataFrame([("en", 3 * 10**13)], "lang string, n_words long")
    with mock.patch.object(P, "shards_of", lambda *a: shards), mock.patch.object(P, "phrase_counts", lambda *a: f):
        assert [tuple(r) for r in P.collocations(None).collect()] == [("en", 1, "a b", 10**13, 2 * 10**13, 10**13 + 1, 3 * 10**13, 2000000 * 10**13 // (3 * 10**13 + 1))]


def test_intervals():
    """Every n-gram of a text with its count, whichever way its intervals were extended."""
    rng = np.random.default_rng(1)
    for longest in (2, 3, 4):
        runs = [rng.integers(1, 5, int(rng.integers(1, 9))) for _ in range(40)]
        text = np.concatenate([np.r_[r, 0] for r in runs])
        want = Counter(tuple(r[i : i + m].tolist()) for r in runs for m in range(2, longest + 1) for i in range(len(r) - m + 1))
        got = {tuple(g): int(c) for grams, n in P.ngrams(text, longest) for g, c in zip(grams.tolist(), n)}
        assert got == dict(want)
