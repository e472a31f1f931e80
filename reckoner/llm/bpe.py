"""Byte-level BPE by replaying the merges over a corpus.

A block of documents is cut into pieces by the split pattern. The block's
different pieces stand side by side as one symbol sequence, with an inverted
index from a merge's rank to the positions where its pair stands. Ranks are taken
in order: all positions of a rank merge, from left to right, and only the two
neighbours of each are looked up again and enter the index. If a merge makes a
pair of a lower rank, that pair goes first and the rest waits, so that each piece
sees the order it would see alone. A block's size changes no result, because no
merge crosses a piece.

Defined cases: null is the empty text, which has no ids; special tokens are
ordinary text; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import table

BLOCK_CHARS = 1_000_000
KEPT_PIECES = 200_000
TEXTS_AT_ONCE = 1000
ROUND_TRIP = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


class Vocabulary:
    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.of_two = np.full(65_536, -1)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.of_two[token[0] << 8 | token[1]] = rank

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, none empty, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        octets = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        n = len(octets)
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        symbol = [*self.of_byte[octets].tolist(), -1]
        after = np.arange(1, n + 2)
        after[ends - 1] = n
        before = np.arange(-1, n)
        before[starts] = n
        after, before = after.tolist(), before.tolist()

        first = np.full(n, -1)
        first[:-1] = self.of_two[octets[:-1] << 8 | octets[1:]]
        first[ends - 1] = -1
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        ranks, bounds = np.unique(first[at], return_index=True)
        index = {rank: part.tolist() for rank, part in zip(ranks.tolist(), np.split(at, bounds[1:]))} if len(at) else {}
        waiting = list(index)
        heapify(waiting)

        pairs = self.pairs
        find = pairs.get
        while waiting:
            rank = heappop(waiting)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                j = after[i]
                if find(symbol[i] << 20 | symbol[j]) != rank or symbol[i] < 0 or symbol[j] < 0:
                    continue
                symbol[i], symbol[j] = rank, -1
                m = after[i] = after[j]
                lower = False
                if m != n:
                    before[m] = i
                    made = find(rank << 20 | symbol[m])
                    if made is not None:
                        lower = made < rank
                        if made in index:
                            index[made].append(i)
                        else:
                            index[made] = [i]
                            heappush(waiting, made)
                p = before[i]
                if p != n:
                    made = find(symbol[p] << 20 | rank)
                    if made is not None:
                        lower = lower or made < rank
                        if made in index:
                            index[made].append(p)
                        else:
                            index[made] = [p]
                            heappush(waiting, made)
                if lower:
                    index[rank] = places[k + 1 :]
                    heappush(waiting, rank)
                    break
        symbols = np.array(symbol[:n])
        alive = symbols >= 0
        packed = symbols[alive].astype("<u4").tobytes()
        counts = np.add.reduceat(alive, starts) if n else np.empty(0, int)
        stops = (np.cumsum(counts) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops)]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        new, ranks = [], self.vocabulary.ranks
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        for piece in pieces - self.known.keys():
            rank = ranks.get(piece.encode())
            if rank is None:
                new.append(piece)
            else:
                self.known[piece] = rank.to_bytes(4, "little")
        self.known.update(zip(new, self.vocabulary.replay([p.encode() for p in new])))

    def _long(self, text: str) -> bytes:
        found, out = (m[0] for m in self.split.finditer(text)), []
        while part := list(islice(found, BLOCK_CHARS // 8)):
            self._learn(set(part))
            out += map(self.known.__getitem__, part)
        return b"".join(out)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        block: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > BLOCK_CHARS:
                yield from self._ids(block)
                block, size = [], 0
                yield self._long(text)
                continue
            block.append(self.split.findall(text))
            size += len(text)
            if size > BLOCK_CHARS:
                yield from self._ids(block)
                block, size = [], 0
        yield from self._ids(block)

    def _ids(self, block: list[list[str]]) -> Iterator[bytes]:
        if block:
            self._learn(set().union(*block))
            known = self.known.__getitem__
            for pieces in block:
                yield b"".join(map(known, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[tuple, Encoder] = {}


def _encoder(content: bytes, pattern: str) -> Encoder:
    key = (hash(content), pattern)
    if key not in _made:
        _made[key] = Encoder(Vocabulary(content), pattern)
    return _made[key]


def _shared(spark: SparkSession, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "coded") -> DataFrame:
    """docs with a struct: ids (little-endian unsigned 32-bit) of the whole text, and the bytes that they decode to."""
    shared = _shared(docs.sparkSession, ranks_path)

    @arrow_udf(ROUND_TRIP)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value, pattern)
        for texts in batches:
            ids, decoded = [], []
            for coded in encoder.encode(texts.to_pylist()):
                ids.append(coded)
                decoded.append(encoder.decode(coded))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["ids", "decoded"])

    return docs.withColumn(out_col, code(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the ids of the whole text."""
    shared = _shared(docs.sparkSession, ranks_path)

    @arrow_udf(T.BinaryType())
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value, pattern)
        for texts in batches:
            yield pa.array(list(encoder.encode(texts.to_pylist())), pa.binary())

    return docs.withColumn(out_col, code(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for; null ids give none."""
    shared = _shared(docs.sparkSession, ranks_path)

    @arrow_udf(T.BinaryType())
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value, "")
        for ids in batches:
            yield pa.array([encoder.decode(x or b"") for x in ids.to_pylist()], pa.binary())

    return docs.withColumn(out_col, text_of(F.col(ids_col)))


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document; ids and decoded bytes are hashed where they are made."""
    shared = _shared(docs.sparkSession, ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    split = pattern or public_tokenizers.PATTERN

    @arrow_udf(DIGESTS)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value, split)
        for texts in batches:
            sizes, ids, decoded = [], [], []
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                for coded in encoder.encode(texts.slice(at, TEXTS_AT_ONCE).to_pylist()):
                    sizes.append(len(coded) // 4)
                    ids.append(hashlib.sha256(coded).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(coded)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    coded = docs.select("doc_id", code(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("coded"))
    return coded.select("doc_id", "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
