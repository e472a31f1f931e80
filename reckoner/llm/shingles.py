"""Near-duplicates by the Jaccard similarity of their word shingles.

A text is the set of its shingles of `words` words, lower case, as XXH64 values
(seed 42). In any order of all values, two texts of similarity t or more share one
of their first n - ceil(t * n) + 1, so candidates are texts that meet at such a
value. The order is that of the hash, but values at which more than CROWD texts
meet in it come last: a passage that many texts hold then brings together only
those that consist of such passages. Of a candidate pair first sketches are
compared, which cannot make two sets seem further apart than they are, and then,
exactly, all shingles.

Where up to CROWD texts meet at a value, all their pairs are candidates. At a
larger meeting a text is at first paired with its NEXT successors, in an order that
differs from meeting to meeting, which connects large groups of copies. Then the
rest: meetings that still hold texts of more than one component are cut into cells
of two blocks, and in each cell the pairs of different components are candidates as
well, at the first such meeting they share, as far as the first LEADS of each tell.
So the pairs found connect just what all pairs of that similarity connect; up to
CROWD they are all of them.

Defined cases: a text of fewer words is one shingle; null, empty or blank text has
none and no links; equal texts are one text; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED = 42
CROWD, NEXT = 32, 4
CELL = 1024  # rows of a block of a crowded meeting
LEADS = 16  # meetings by which a pair is known to have met before
HELD = 100_000
MARKS = 1 << 24  # bits: a bound for what the driver holds
COMMON, COMMON_BITS = 1 << 20, 1 << 25  # values the driver collects at most to put last, and bits they are broadcast as


def node(text: Column) -> Column:
    """What stands for a text: a hash of its bytes."""
    return F.xxhash64(text)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The different shingles' hashes in ascending order."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.int64)
    norm = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(norm, SEED)], np.uint64).view(np.int64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = [0, *(gaps[: len(gaps) - words + 1] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(norm)]
    return np.unique(np.array([digest(norm[a:b], SEED) for a, b in zip(starts, ends)], np.uint64).view(np.int64))


def _in_order(own: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    """Ascending values in the order of all values: those marked as common last."""
    if common is None or not len(own):
        return own
    at = own.view(np.uint64) % np.uint64(COMMON_BITS)
    last = common[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
    return np.concatenate([own[last == 0], own[last == 1]])


def _first(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _first_keys(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": np.concatenate([np.empty(0, np.int64), *(x[: _first(len(x), similarity)] for x in sets)])})

    return run


def common_values(texts: DataFrame, words: int, similarity: float):
    """A broadcast bit mask of values at which more than CROWD texts meet: the commonest, whole classes of count, COMMON at most."""
    counts = texts.mapInArrow(_first_keys(words, similarity), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
    counts = cut(counts.withColumn("size", F.floor(F.log2("n") * 4).cast("int")))
    least, held = 1 << 20, 0
    for row in sorted(counts.groupBy("size").count().collect(), key=lambda r: -r["size"]):
        held += row["count"]
        if held > COMMON:
            break
        least = row["size"]
    keys = counts.filter(F.col("size") >= least).select("key").toArrow().column("key").to_numpy().astype(np.int64)
    marked = np.zeros(COMMON_BITS, bool)
    marked[(keys.view(np.uint64) % np.uint64(COMMON_BITS)).astype(np.int64)] = True
    return texts.sparkSession.sparkContext.broadcast(np.packbits(marked, bitorder="little"))


def _firsts(words: int, similarity: float, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, places, sizes = [], [], [], []
            for name, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                own = _in_order(shingles(text, words), common.value)
                n = len(own)
                first = _first(n, similarity)
                keys.append(own[:first])
                nodes.append(np.full(first, name, np.int64))
                places.append(np.arange(first, dtype=np.int32))
                sizes.append(np.full(first, n, np.int32))
            if keys:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in (("key", keys), ("node", nodes), ("place", places), ("n", sizes))})

    return run


def _possible(similarity: float, place: tuple[np.ndarray, np.ndarray], n: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether texts that meet at these places can share as many values as the similarity takes."""
    (pa_, pb), (na, nb) = place, n
    least = similarity / (1 + similarity) * (na.astype(np.int64) + nb)
    return np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb) >= least - 1e-9


def _pairs_of(similarity: float, key: np.ndarray, node: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs among rows sorted by key, and which rows are at meetings of more than CROWD; whole meetings."""
    size = np.searchsorted(key, key, side="right") - np.searchsorted(key, key, side="left")
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for d in range(1, CROWD):
        at = np.flatnonzero(key[d:] == key[:-d])
        if not len(at):
            break
        if d > NEXT:
            at = at[size[at] <= CROWD]
        found.append((at, at + d))
    a, b = (np.concatenate(x) for x in zip(*found))
    open_ = _possible(similarity, (place[a], place[b]), (n[a], n[b])) & (node[a] != node[b])
    low, high = np.minimum(node[a[open_]], node[b[open_]]), np.maximum(node[a[open_]], node[b[open_]])
    both = np.unique(np.stack([low, high]), axis=1)
    return both[0], both[1], size > CROWD


def _meet(similarity: float):
    """Rows of two kinds: candidate pairs (key null), and the rows of crowded meetings (node as a, b null)."""
    columns = ("key", "node", "place", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(part[0]) > 1:
                a, b, crowded = _pairs_of(similarity, *part)
                key, node, place, n = (x[crowded] for x in part)
                none = pa.nulls(len(a))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32())], names=["a", "b", "key", "place", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(key), pa.array(place), pa.array(n)], names=["a", "b", "key", "place", "n"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            if len(held[0]) < HELD:
                continue
            whole = int(np.searchsorted(held[0], held[0][-1], side="left"))
            yield from done([x[:whole] for x in held])
            held = [x[whole:] for x in held]
        if held:
            yield from done(held)

    return run


def sketch(own: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes, set where an odd number of them has it; as many bits as hashes or up to twice that."""
    bits = max(8, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits((np.bincount((own.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Not more than the number of hashes that only one of the two sets has."""
    one, two = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(one) > len(two):
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    while len(two) > len(one):
        two = two[: len(two) // 2] ^ two[len(two) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "n": pa.array([len(x) for x in sets], pa.int32()), "odd": pa.array([sketch(x) for x in sets], pa.binary())})

    return run


def _close(similarity: float):
    """Pairs whose sketches leave the similarity possible."""
    far = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n, x, y = (batch.column(c).to_pylist() for c in ("m", "n", "x", "y"))
            keep = pa.array([apart(x[i], y[i]) <= far * (m[i] + n[i]) + 1e-9 for i in range(len(m))], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _sets(words: int, marks):
    """The shingles of texts with a mark: those of the close pairs, and some more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("node").to_numpy(zero_copy_only=False)
            at = names % MARKS
            chosen = np.flatnonzero(marks.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            found = batch.column("text").take(pa.array(chosen)).to_pylist()
            yield pa.RecordBatch.from_pydict({"node": pa.array(names[chosen], pa.int64()), "own": pa.array([shingles(t, words) for t in found], pa.list_(pa.int64()))})

    return run


def _folded(odd: np.ndarray, size: int) -> np.ndarray:
    """Sketches, one a row, as of fewer bits."""
    while odd.shape[1] > size:
        odd = odd[:, : odd.shape[1] // 2] ^ odd[:, odd.shape[1] // 2 :]
    return odd


def _met_before(key: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the rows' leads, padded to LEADS, share a meeting before this one; a pair's first meeting never has one."""
    return ((one[:, :, None] == two[:, None, :]) & (one < key)[:, :, None]).any(axis=(1, 2))


def _cells(similarity: float):
    """Candidates among the rows of one cell: pairs of different components that have not met before and whose sketches leave the similarity possible."""
    far = (1 - similarity) / (1 + similarity)

    def run(key, rows):
        import pandas as pd

        rows = rows.drop_duplicates("node")
        block, comp, names, place, n = (rows[c].to_numpy() for c in ("block", "comp", "node", "place", "n"))
        sizes = rows["odd"].map(len).to_numpy()
        leads = np.full((len(rows), LEADS), np.iinfo(np.int64).max)
        for at, own in enumerate(rows["leads"]):
            leads[at, : len(own)] = own
        i, j = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        found = [np.empty((2, 0), np.int64)]
        for x in np.unique(sizes[i]):
            for y in np.unique(sizes[j]):
                one, two = i[sizes[i] == x], j[sizes[j] == y]
                a, b = (at[k] for at, k in zip((one, two), np.nonzero(comp[one][:, None] != comp[two][None, :])))
                ok = _possible(similarity, (place[a], place[b]), (n[a], n[b])) & ((key[1] != key[2]) | (names[a] < names[b]))
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                least = min(x, y)
                odd_one, odd_two = (_folded(np.frombuffer(b"".join(rows["odd"].iloc[at]), np.uint8).reshape(len(at), -1), least) for at in (one, two))
                for at in range(0, len(a), 1 << 18):
                    p, q = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
                    apart_by = np.bitwise_count(odd_one[np.searchsorted(one, p)] ^ odd_two[np.searchsorted(two, q)]).sum(axis=1)
                    near = apart_by <= far * (n[p].astype(np.int64) + n[q]) + 1e-9
                    p, q = p[near], q[near]
                    for k in range(0, len(p), 1 << 14):
                        c, d = p[k : k + (1 << 14)], q[k : k + (1 << 14)]
                        new = ~_met_before(key[0], leads[c], leads[d])
                        found.append(np.stack([names[c[new]], names[d[new]]]))
        a, b = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _verified(texts: DataFrame, close: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of close that have the similarity."""
    marks = close.select(F.explode(F.array("a", "b")).alias("node")).select(F.pmod("node", F.lit(MARKS)).cast("int").alias("mark")).distinct()
    marked = np.zeros(MARKS, bool)
    marked[marks.toArrow().column("mark").to_numpy()] = True
    shared_marks = texts.sparkSession.sparkContext.broadcast(np.packbits(marked))
    sets = cut(texts.mapInArrow(_sets(words, shared_marks), "node long, own array<long>").dropDuplicates(["node"]))
    both = close.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def _crowds(rows: DataFrame, odd: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b) of the crowded meetings' rows that lie in more than one component. roots: (u, v), each node with its component's smallest."""
    roots = roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
    rows = cut(rows.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"))
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("here"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key", F.ceil(F.col("here") / CELL).cast("int").alias("blocks"))
    split = cut(rows.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    leads = split.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEADS).alias("leads"))
    split = split.join(leads, "node").join(odd.select("node", "odd"), "node")
    dealt = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(tasks, "key", "lo", "hi").groupBy("key", "lo", "hi").applyInPandas(_cells(similarity), "a long, b long").distinct()


def _searched(texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Similar pairs (a, b) of a first search; its components as (u, v), v the smallest; similar pairs that join those further."""
    from .simhash import components

    common = common_values(texts, words, similarity)
    met = texts.mapInArrow(_firsts(words, similarity, common), "key long, node long, place int, n int").repartition("key")
    met = cut(met.sortWithinPartitions("key", F.xxhash64("key", "node")).mapInArrow(_meet(similarity), "a long, b long, key long, place int, n int"))
    pairs = cut(met.filter("key IS NULL").select("a", "b").distinct())
    odd = cut(texts.mapInArrow(_sketches(words), "node long, n int, odd binary").dropDuplicates(["node"]))
    close = cut(
        pairs.join(odd.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("odd").alias("x")), "a")
        .join(odd.select(F.col("node").alias("b"), "n", F.col("odd").alias("y")), "b")
        .mapInArrow(_close(similarity), "a long, b long")
    )
    first = cut(_verified(texts, close, words, similarity))
    roots = components(first.select(F.col("b").alias("u"), F.col("a").alias("v")))
    crowded = met.filter("key IS NOT NULL").select("key", F.col("a").alias("node"), "place", "n")
    rest = cut(_crowds(crowded, odd, roots, similarity))
    return first, roots, _verified(texts, rest, words, similarity)


def similar(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b), a < b: nodes of texts whose shingles have this similarity or more, and which connect just what all such pairs connect. texts: node, text as bytes."""
    first, _, rest = _searched(texts, words, similarity)
    return first.unionByName(rest).distinct()


def connecting(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b), a < b: nodes that connect just what the pairs of `similar` connect. What the first search connects comes as stars, one row a text, whose ends need not be similar."""
    _, roots, rest = _searched(texts, words, similarity)
    return roots.select(F.col("v").alias("a"), F.col("u").alias("b")).unionByName(rest).distinct()
