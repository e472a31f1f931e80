"""Vector codes by k-means over anchors-hierarchy metric trees.

Vectors are turned into integers and cut into PARTS parts. Tasks gather them in blocks;
for each part of a block a metric tree is built from the middle: anchors are chosen one
after another as the point farthest from its anchor and take over the points that are
nearer to them, of which only those farther from their anchor than half the way to the
new one can be; anchors are then merged upwards, two by two, into the ball that stays
smallest, and each anchor's points become anchors of their own downwards. Every ball
keeps the count and sum of its points.

A round of k-means sends all 64 entries into the root of each tree. A ball inherits its
parent's candidates and drops those that cannot be nearest to any point inside: centre
to entry minus radius is more than the best centre to entry plus radius. When one entry
is left the ball is wholly owned and its cached count and sum are added; points of balls
that stay undecided at the bottom are compared exactly with the candidates left, in
integers. Rounding can only keep a candidate too many, so the result is the plain
algorithm's. Tasks return sums for each part and entry; blocks and trees are written once
and read again in each round.

Defined cases: vectors that are null or hold null or non-finite components are left out;
repeated ids each keep their row, equal ids start the codebooks in the order of their
vectors, null ids last; vectors of another length than most, or of no components, stay
with null code and error; where the length is no multiple of PARTS, first parts are one
longer, and without a component a part costs nothing; fewer vectors than entries make
fewer entries; scaled components are held within bounds (LIMIT) in which squared
distances fit 64 bits, about 2^27 for parts of four; no rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_VALUES = 1 << 20  # components in a block
LEAF = 16  # points of a ball that is not split
ANCHORS = 128  # of one ball at most


def bounds_of(size: int, parts: int = PARTS) -> list[int]:
    return np.cumsum([0, *(size // parts + (k < size % parts) for k in range(parts))]).tolist()


def limit_of(size: int, parts: int = PARTS) -> int:
    """How large a scaled component may be for squared distances of whole vectors to fit 62 bits."""
    return math.isqrt((1 << 58) // max(1, -(-size // parts))) // 2


def scaled(vectors: np.ndarray, limit: int) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -limit, limit).astype(np.int64)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - entries[None, :, d]) ** 2
    return out


class Tree:
    """Metric tree over integer points. Ball i holds points order[low[i]:high[i]] and has children kids[i] (-1: none)."""

    def __init__(self, points: np.ndarray):
        self._points = points.astype(np.float64)
        self._kids: list[tuple[int, int]] = []
        self._leaf: list[np.ndarray | None] = []
        self.root = self._grown(np.arange(len(points)))
        self._placed(points)
        del self._points, self._kids, self._leaf

    def _ball(self, kids: tuple[int, int], leaf: np.ndarray | None) -> int:
        self._kids.append(kids)
        self._leaf.append(leaf)
        return len(self._kids) - 1

    def _anchored(self, of: np.ndarray) -> list[np.ndarray]:
        """The points of each anchor of a set of points."""
        points = self._points[of]
        most = min(ANCHORS, math.isqrt(len(of) - 1) + 1)
        anchors = [0]
        owner, far = np.zeros(len(of), np.int64), np.sqrt(((points - points[0]) ** 2).sum(axis=1))
        while len(anchors) < most:
            new = int(far.argmax())
            if far[new] == 0:
                break
            way = np.sqrt(((points[anchors] - points[new]) ** 2).sum(axis=1))
            open_ = np.flatnonzero(far > way[owner] / 2)
            near = np.sqrt(((points[open_] - points[new]) ** 2).sum(axis=1))
            taken = open_[near < far[open_]]
            far[taken] = near[near < far[open_]]
            owner[taken] = len(anchors)
            anchors.append(new)
        order = np.argsort(owner, kind="stable")
        return [p for p in np.split(of[order], np.cumsum(np.bincount(owner, minlength=len(anchors)))[:-1]) if len(p)]

    def _grown(self, of: np.ndarray) -> int:
        """Balls of a set of points, from its anchors up and down."""
        sets = self._anchored(of) if len(of) > LEAF else [of]
        if len(sets) == 1:
            return self._ball((-1, -1), of)
        ball = [self._grown(s) for s in sets]
        centre = np.stack([self._points[s].mean(axis=0) for s in sets])
        radius = np.array([np.sqrt(((self._points[s] - c) ** 2).sum(axis=1)).max() for s, c in zip(sets, centre)])
        size = np.array([float(len(s)) for s in sets])
        way = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
        cost = np.maximum((way + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(sets) - 1):
            a, b = divmod(int(cost.argmin()), len(sets))
            ball[a] = self._ball((ball[a], ball[b]), None)
            middle = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            radius[a] = max(radius[a] + np.sqrt(((centre[a] - middle) ** 2).sum()), radius[b] + np.sqrt(((centre[b] - middle) ** 2).sum()))
            centre[a], size[a] = middle, size[a] + size[b]
            cost[b], cost[:, b] = np.inf, np.inf
            alive = np.isfinite(cost[a])
            way = np.sqrt(((centre - middle) ** 2).sum(axis=1))
            fresh = np.where(alive, np.maximum((way + radius + radius[a]) / 2, np.maximum(radius, radius[a])), np.inf)
            cost[a], cost[:, a] = fresh, fresh
            last = a
        return ball[last]

    def _placed(self, points: np.ndarray) -> None:
        """Points in the order of the leaves; counts, sums, centres and radii of the balls."""
        n = len(self._kids)
        self.kids = np.array(self._kids, np.int64).reshape(n, 2)
        self.low, self.high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        leaves, at, stack = [], 0, [self.root]
        first = []  # balls, parents before children
        while stack:
            i = stack.pop()
            first.append(i)
            if (leaf := self._leaf[i]) is not None:
                self.low[i], self.high[i] = at, at + len(leaf)
                leaves.append(leaf)
                at += len(leaf)
            else:
                stack += self._kids[i][::-1]
        for i in reversed(first):
            if self._leaf[i] is None:
                a, b = self._kids[i]
                self.low[i], self.high[i] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.order = np.concatenate(leaves)
        self.points = points[self.order]
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        self.sums = sums[self.high] - sums[self.low]
        self.counts = self.high - self.low
        self.centres = self.sums / self.counts[:, None]
        self.radii = np.zeros(n)
        for i in reversed(first):
            if self._leaf[i] is None:
                kids = self.kids[i]
                self.radii[i] = (self.radii[kids] + np.sqrt(((self.centres[kids] - self.centres[i]) ** 2).sum(axis=1))).max()
            else:
                self.radii[i] = np.sqrt(((self.points[self.low[i] : self.high[i]] - self.centres[i]) ** 2).sum(axis=1)).max()

    def owners(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(balls, their only candidate, True) for balls that one entry owns wholly, (points in order, their nearest entry, False) for the rest."""
        slack = 1e-9 * (1 + float(np.abs(self.points).max(initial=0)) + float(np.abs(entries).max(initial=0)))
        balls = np.array([self.root])
        open_ = np.ones((1, len(entries)), bool)
        while len(balls):
            way = np.sqrt(((self.centres[balls][:, None] - entries[None].astype(np.float64)) ** 2).sum(axis=2))
            way[~open_] = np.inf
            open_ &= way <= way.min(axis=1, keepdims=True) + 2 * self.radii[balls, None] + slack
            one = open_.sum(axis=1) == 1
            yield balls[one], open_[one].argmax(axis=1), True
            balls, open_ = balls[~one], open_[~one]
            leaf = self.kids[balls, 0] < 0
            if leaf.any():
                n = self.counts[balls[leaf]]
                of = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(of)) + np.repeat(self.low[balls[leaf]] - (np.cumsum(n) - n), n)
                for a in range(0, len(place), 8192):
                    some = place[a : a + 8192]
                    exact = squared(self.points[some], entries)
                    exact[~open_[leaf][of[a : a + 8192]]] = np.iinfo(np.int64).max
                    yield some, exact.argmin(axis=1), False
            balls, open_ = self.kids[balls[~leaf]].reshape(-1), np.repeat(open_[~leaf], 2, axis=0)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of each entry's points."""
        n, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        for who, entry, whole in self.owners(entries):
            np.add.at(n, entry, self.counts[who] if whole else 1)
            np.add.at(sums, entry, self.sums[who] if whole else self.points[who])
        return n, sums

    def nearest(self, entries: np.ndarray) -> np.ndarray:
        """Each point's nearest entry, in the points' first order."""
        out = np.empty(len(self.order), np.int64)
        for who, entry, whole in self.owners(entries):
            if whole:
                n = self.counts[who]
                out[np.arange(n.sum()) + np.repeat(self.low[who] - (np.cumsum(n) - n), n)] = np.repeat(entry, n)
            else:
                out[who] = entry
        back = np.empty_like(out)
        back[self.order] = out
        return back


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("trees", pa.binary())])
_BLOCK_DDL = "ids array<long>, labels array<string>, trees binary"


def _blocks(size: int, rows: int):
    bounds, limit = bounds_of(size), limit_of(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0

        def block(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks().to_batches()[0]
            points = scaled(_matrix(part, size), limit)
            trees = [Tree(points[:, a:b]) for a, b in zip(bounds, bounds[1:])]
            columns = ([part.column("vec_id").to_pylist()], [part.column("label").to_pylist()], [pickle.dumps(trees)])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            while waiting >= rows:
                whole = pa.Table.from_batches(held)
                yield block(whole.slice(0, rows))
                held, waiting = whole.slice(rows).to_batches(), waiting - rows
        if waiting:
            yield block(pa.Table.from_batches(held))

    return run


def _totals(codebooks: list[np.ndarray]):
    """part, entry, place (-1: count), total of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trees in batch.column("trees"):
                out: list[np.ndarray] = []
                for part, (tree, entries) in enumerate(zip(pickle.loads(trees.as_py()), codebooks)):
                    n, sums = tree.totals(entries)
                    places = np.concatenate([n[:, None], sums], axis=1)
                    entry, place = np.indices(places.shape)
                    out.append(np.stack([np.full(places.size, part), entry.ravel(), place.ravel() - 1, places.ravel()]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["part", "entry", "place", "total"])

    return run


def _coded(codebooks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                codes, error = [], np.zeros(len(ids), np.int64)
                for tree, entries in zip(pickle.loads(batch.column("trees")[i].as_py()), codebooks):
                    code = tree.nearest(entries)
                    codes.append(code)
                    error[tree.order] += ((tree.points - entries[code[tree.order]]) ** 2).sum(axis=1)
                texts = [row.tobytes().hex() for row in np.stack(codes, axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


class Codebooks:
    """Entries of each part, and codes of each vector."""

    def __init__(self, entries: list[np.ndarray], codes: DataFrame):
        self.entries, self.codes = entries, codes

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, block_values: int = BLOCK_VALUES) -> Codebooks:
    """Codebooks of PARTS parts after so many rounds, and vec_id, label, code, error of each vector that takes part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("vector"))
    sizes = kept.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    same = kept.filter(F.size("vector") == size)
    first = same.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    bounds = bounds_of(size)
    start = scaled(np.array([r["vector"] for r in first], np.float64).reshape(len(first), size), limit_of(size))
    entries = [start[:, a:b] for a, b in zip(bounds, bounds[1:])]
    blocks = written(same.mapInArrow(_blocks(size, max(1, block_values // max(1, size))), _BLOCK_DDL), "blocks")
    for _ in range(rounds if size else 0):
        sums = blocks.mapInArrow(_totals(entries), "part long, entry long, place long, total long")
        rows = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # as many as the codebooks have components
        totals = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in rows}
        entries = [
            np.array([[totals[p, e, d] // totals[p, e, -1] if totals[p, e, -1] else int(old[d]) for d in range(len(old))] for e, old in enumerate(part)], np.int64).reshape(part.shape)
            for p, part in enumerate(entries)
        ]
    coded = blocks.mapInArrow(_coded(entries), "vec_id long, label string, code string, error long")
    odd = kept.filter(F.size("vector") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Codebooks(entries, written(coded.unionByName(odd), "codes"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = compress(table(spark, sf_dir, "embeddings"))
    codes = books.codes
    of_label = codes.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return codes.join(of_label, F.col("label").eqNullSafe(F.col("same")), "left").select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _oracle() -> str:
    """Each part's entries are lists; a round assigns every part and averages by floor."""
    parts = f"""
WITH v AS (SELECT vec_id, label, [floor(x::DOUBLE * {SCALE})::BIGINT FOR x IN embedding] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, x[part * len(x) // {PARTS} + 1:(part + 1) * len(x) // {PARTS}] AS y FROM (SELECT *, unnest(range({PARTS})) AS part FROM v)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS e FROM p QUALIFY entry < {ENTRIES})"""
    near = """
{name} AS (SELECT vec_id, any_value(label) AS label, part, any_value(y) AS y, min({{'d': d, 'entry': entry}}) AS best FROM (
  SELECT p.*, entry, list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(y, e)])::BIGINT AS d FROM p JOIN {book} USING (part)) GROUP BY vec_id, part)"""
    mean = """
{name} AS (SELECT part, entry, coalesce(f, e) AS e FROM {book} LEFT JOIN (
  SELECT part, entry, list(f ORDER BY d) AS f FROM (
    SELECT part, entry, d, (s - ((s % n) + n) % n) // n AS f FROM (
      SELECT part, best.entry AS entry, d, sum(y[d]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(y) + 1)) AS d FROM {near}) GROUP BY ALL)) GROUP BY ALL) USING (part, entry))"""
    steps = [parts]
    for k in range(ROUNDS):
        steps += [near.format(name=f"n{k}", book=f"b{k}"), mean.format(name=f"b{k + 1}", book=f"b{k}", near=f"n{k}")]
    steps.append(near.format(name="z", book=f"b{ROUNDS}"))
    return (
        ",".join(steps)
        + f""",
c AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c"""
    )


ORACLE = _oracle()
