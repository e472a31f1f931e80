import hashlib
import math

import numpy as np
import pytest
from reckoner.llm import vq as V

SCHEMA = "vec_id long, embedding array<float>, label int, code int"


def brute(rows, size, rounds=V.ROUNDS):
    """Plain k-means in Python integers: {id: (code, error)}, entries."""
    bounds = V.bounds_of(size)
    kept = sorted((i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows)
    books = [[v[a:b] for _, v in kept[: V.ENTRIES]] for a, b in zip(bounds, bounds[1:])]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for part, (a, b) in enumerate(zip(bounds, bounds[1:])):
            groups = {}
            for _, v in kept:
                groups.setdefault(nearest(v[a:b], books[part])[1], []).append(v[a:b])
            books[part] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[part])]
    out = {}
    for i, v in kept:
        best = [nearest(v[a:b], book) for book, a, b in zip(books, bounds, bounds[1:])]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best))
    return out, books


@pytest.mark.parametrize("size,kind", [(32, "spread"), (64, "clusters"), (35, "ties")])
def test_matches_plain_kmeans(spark, size, kind):
    rng = np.random.default_rng(size)
    points = rng.normal(size=(400, size)) / 4
    if kind == "clusters":
        points = rng.normal(size=(12, size))[rng.integers(0, 12, 400)] + points / 50
    if kind == "ties":
        points = rng.integers(-1, 2, (400, size)) / 128
        points[200:] = points[0]
    rows = [(int(i) * 3 - 50, p.astype(np.float32).tolist()) for i, p in enumerate(points)]
    none = [(5000, None), (5001, [1.0] * (size - 1) + [None]), (5002, [float("nan")] * size), (5003, [float("inf")] * size)]
    labels = {i: None if i % 5 == 0 else i % 3 for i, _ in rows}
    data = [(i, v, labels.get(i), 9) for i, v in rows + none]
    vectors = spark.createDataFrame(data, SCHEMA).repartition(3)
    want, books = brute(rows, size)
    for values in (V.BLOCK_VALUES, 70 * size):
        got = V.compress(vectors, block_values=values)
        assert {r.vec_id: (r.code, r.error) for r in got.codes.collect()} == want
        assert got.sha256 == hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def test_balls_decide(monkeypatch):
    """Most points of clustered data are owned by whole balls, and trees cache what their points add up to."""
    rng = np.random.default_rng(3)
    points = rng.integers(-900, 900, (40, 4))[rng.integers(0, 40, 5000)] + rng.integers(-5, 6, (5000, 4))
    tree = V.Tree(points)
    assert sorted(tree.order) == list(range(5000)) and tree.counts[tree.root] == 5000
    assert (tree.sums[tree.root] == points.sum(axis=0)).all()
    for i in range(len(tree.counts)):
        inside = tree.points[tree.low[i] : tree.high[i]]
        assert (tree.sums[i] == inside.sum(axis=0)).all()
        assert (np.sqrt(((inside - tree.centres[i]) ** 2).sum(axis=1)) <= tree.radii[i] + 1e-6).all()
    entries = points[:64]
    whole = sum(tree.counts[who].sum() for who, _, owned in tree.owners(entries) if owned)
    assert whole > 1000
    assert (tree.nearest(entries) == V.squared(points, entries).argmin(axis=1)).all()


def test_cases(spark):
    assert V.compress(spark.createDataFrame([], SCHEMA)).codes.collect() == []
    rows = [(None, [0.5] * 16, 1, 0), (2, [0.25] * 16, None, 0), (2, [0.125] * 16, None, 0), (3, [1.0] * 3, 1, 0), (4, [], 1, 0), (5, [1e30] * 16, 2, 0)]
    got = sorted((tuple(r) for r in V.compress(spark.createDataFrame(rows, SCHEMA)).codes.collect()), key=repr)
    assert [(r[0], r[2], r[3]) for r in got] == [(2, "00" * 16, 0), (2, "01" * 16, 0), (3, None, None), (4, None, None), (5, "02" * 16, 0), (None, "03" * 16, 0)]
    assert V.compress(spark.createDataFrame([(1, None, None, None)], SCHEMA)).codes.collect() == []


def test_query(spark):
    from collections import Counter

    sums = Counter()
    rows = V.op11_vector_codes(spark, "/root/testdata/sf0.001").collect()
    labels = {r.vec_id: r.label for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    for r in rows:
        sums[labels[r.vec_id]] += r.error
    assert rows and all(r.label_error == sums[labels[r.vec_id]] and len(r.code) == 32 for r in rows)
