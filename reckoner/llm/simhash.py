"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has a bit set where more than half of its three-word
shingles' XXH64 values (seed 42) have it. Two fingerprints link when they differ
in at most two bits; a component is everything reachable over links.

Anchors: a covering code on all 64 bits, the product of the perfect binary Golay
code (bits 0-22, covering radius 3) and all words (bits 23-63, radius 0). Where two
fingerprints differ in two bits, a value between them differs in one from each;
that value has an anchor within the radius, so both are within radius plus half the
threshold of it, on the part where they leave the value. Each fingerprint is
therefore replicated to its own anchor, the Golay codewords at distance 4 with its
own word, and its own codeword with each of the 41 words one bit away: about 46
rows. Fingerprints that meet at an anchor are compared. No anchor can be met by
more than some 95,000 different fingerprints, however many documents there are,
and only fingerprints that differ are replicated, so exact copies cost nothing.

Defined cases: null, empty or blank text has fingerprint zero and links like any
other; one or two words make one shingle; repeated and null document ids keep their
rows, of which one, the first of the smallest id, stays of each component (kept); a
component of null ids alone has a null id; other columns are ignored; no rows give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import ROW, cut, keyed, table, utf8
from .shingles import connecting, node

SEED = 42
THRESHOLD = 2
RADIUS = 3
BITS = 23
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
WORD_BITS = 64 - BITS
ALL_PAIRS = 512  # fingerprints at an anchor up to which all their pairs are compared, else those one bit from one value
HOT = 1 << 16  # rows of one fingerprint from which they meet its component by broadcast: at most one in HOT rows
NO_ID = 2**63 - 1

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_SHIFT = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = text.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) < 4:
        return xxhash.xxh64_intdigest(norm, SEED)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = [0, *(gaps[:-2] + 1).tolist()]
    ends = [*gaps[2:].tolist(), len(norm)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(norm[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_SHIFT
    seen = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (2 * seen.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@arrow_udf(T.LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def _syndromes(values: np.ndarray) -> np.ndarray:
    rest = values.astype(np.int64)
    for bit in range(BITS - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _error_lists() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For distances within the radius and one beyond: offsets and counts by syndrome, and the error patterns."""
    by_weight = [np.array([sum(1 << b for b in c) for c in combinations(range(BITS), w)]) for w in range(RADIUS + 2)]
    out = []
    for patterns in (np.concatenate(by_weight[: RADIUS + 1]), by_weight[RADIUS + 1]):
        s = _syndromes(patterns)
        order = np.argsort(s, kind="stable")
        counts = np.bincount(s, minlength=2048)
        out.append((np.concatenate([[0], np.cumsum(counts)[:-1]]), counts, patterns[order]))
    return out


_ERRORS: list | None = None


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the fingerprint, anchor) for each replica; an anchor is a codeword's 12 data bits before a word's 41."""
    global _ERRORS
    if _ERRORS is None:
        _ERRORS = _error_lists()
    bits = fps.view(np.uint64)
    one = (bits & np.uint64((1 << BITS) - 1)).astype(np.int64)
    word = (bits >> np.uint64(BITS)).astype(np.int64)
    syndrome = _syndromes(one)
    (start, _, near), (start_far, counts, far) = _ERRORS
    own = (one ^ near[start[syndrome]]) >> 11
    every = np.arange(len(fps))
    flipped = (word[:, None] ^ (1 << np.arange(WORD_BITS))).ravel()
    reps = counts[syndrome]
    row = np.repeat(every, reps)
    k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    beyond = (one[row] ^ far[start_far[syndrome[row]] + k]) >> 11
    code = np.concatenate([own, np.repeat(own, WORD_BITS), beyond])
    return np.concatenate([every, np.repeat(every, WORD_BITS), row]), code << WORD_BITS | np.concatenate([word, flipped, word[row]])


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 16_384):
            part = fps[at : at + 16_384]
            row, anchor = anchors(part)
            yield pa.RecordBatch.from_pydict({"anchor": anchor, "fp": part[row]})


def _linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs within two bits of each other that connect what all such pairs connect. fps: all different."""
    if len(fps) <= ALL_PAIRS:
        left, right = np.triu_indices(len(fps), 1)
        near = np.bitwise_count(fps[left].view(np.uint64) ^ fps[right].view(np.uint64)) <= THRESHOLD
        return left[near], right[near]
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    between = (fps.view(np.uint64)[:, None] ^ flips[None, :]).ravel()
    order = np.argsort(between, kind="stable")
    same = np.flatnonzero(between[order[1:]] == between[order[:-1]])
    return order[same] // 65, order[same + 1] // 65


def _links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among rows sorted by anchor, within each anchor."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(bounds)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in range(2, min(16, sizes.max(initial=0)) + 1):
        first = bounds[:-1][sizes == size]
        for i, j in combinations(range(size), 2):
            near = np.bitwise_count(fps[first + i].view(np.uint64) ^ fps[first + j].view(np.uint64)) <= THRESHOLD
            left.append(first[near] + i)
            right.append(first[near] + j)
    for at in np.flatnonzero(sizes > 16):
        a, b = _linked(fps[bounds[at] : bounds[at + 1]])
        left.append(a + bounds[at])
        right.append(b + bounds[at])
    return np.concatenate(left), np.concatenate(right)


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """The pairs' connected parts as stars: each member with the part's smallest."""
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    a, b = fps[label[moved]], fps[moved]
    return pa.RecordBatch.from_pydict({"u": np.maximum(a, b), "v": np.minimum(a, b)})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares within each anchor; rows come sorted by anchor. Whole anchors at a time."""
    held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64)]

    def done(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = _links_of(keys, fps)
        if len(left):
            yield _forest(fps, left, right)

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp")]
        held = [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]) < 100_000:
            continue
        whole = int(np.searchsorted(held[0], held[0][-1], side="left"))
        yield from done(*[x[:whole] for x in held])
        held = [x[whole:] for x in held]
    yield from done(*held)


def links(fps: DataFrame) -> DataFrame:
    """(u, v), u > v as signed longs: pairs within two bits that connect just what all such pairs connect. fps: different values of fp."""
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        fps.repartition(tasks, "fp")
        .mapInArrow(_replicas, "anchor long, fp long")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_compare, "u long, v long")
        .distinct()
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): each node but a component's smallest, with that smallest. Alternating stars, lineage cut each round."""
    edges = cut(edges.select("u", "v"))
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        after = cut(small.filter("u <> v").distinct())
        if after.count() == edges.count() and not after.exceptAll(edges).take(1):
            return after
        edges = after
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, similarity: float = 0.8) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) and kept for each row of docs, and its place (ROW).

    With `words`, texts whose shingles of so many words have this Jaccard similarity or more link as well.
    """
    return components_of(keyed(docs), id_col, text_col, words, similarity)


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, similarity: float = 0.8) -> DataFrame:
    """As near_duplicates, for docs with the columns ROW."""
    text = utf8(F.col(text_col))
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    prints = cut(docs.select(own_id.alias("id"), *ROW, fingerprint_udf(text).alias("fp"), *([node(text).alias("node")] if words else [])))
    fps = cut(prints.groupBy("fp").agg(F.min(F.struct("id", *ROW)).alias("first"), F.count(F.lit(1)).alias("n")))
    edges = links(fps.select("fp"))
    if words:
        found = connecting(docs.select(node(text).alias("node"), text.alias("text")), words, similarity)
        of = prints.select("node", "fp").distinct()
        ends = found.join(of.select(F.col("node").alias("a"), F.col("fp").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("fp").alias("y")), "b")
        edges = edges.unionByName(ends.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))).distinct()
    roots = components(edges)
    linked = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "n", "first", F.coalesce("v", "fp").alias("root"))
    lows = linked.groupBy("root").agg(F.min("first").alias("keep"))
    named = cut(linked.select("fp", "n", "root").join(lows, "root").select("fp", "n", "keep"))
    # Rows of very common fingerprints meet theirs by broadcast, the others by shuffle.
    hot = named.filter(F.col("n") >= HOT).select("fp", F.col("keep").alias("hot_keep"))
    near = prints.join(F.broadcast(hot), "fp", "left")
    rest = near.filter("hot_keep IS NULL").drop("hot_keep").join(named.filter(F.col("n") < HOT).select("fp", "keep"), "fp")
    every = near.filter("hot_keep IS NOT NULL").withColumnRenamed("hot_keep", "keep").select(*rest.columns).unionByName(rest)
    kept = F.struct("id", *ROW) == F.col("keep")
    return every.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("keep.id", F.lit(NO_ID)).alias("component_id"), kept.alias("kept"), *ROW)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop(*ROW)
