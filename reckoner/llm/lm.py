"""Language-model scoring with a hashed maximum-entropy model.

A word's hash gives its class and its slot in the class. The probability of a token
is that of its class given what stands before, times that of its slot given the
class and what stands before, times its smoothed share of the slot's training
tokens. Both first factors are softmaxes over sparse features: the word before
(bigram), the word two before (skip) and, for the class, both together (trigram),
hashed into tables of fixed size; the slot's features are hashed with the class.

Training is distributed and the same under any partitioning. One pass over all
training documents counts words and how often each feature meets each outcome.
From weights of zero the first step has a closed form in these counts: log ratios,
shrunk to the outcome's share. Then come ROUNDS gradient steps, each over all
training tokens: tasks sum, in sparse numpy batches, what the model expects of each
feature and outcome, in whole units so that order changes nothing; the observed less
the expected, over their sum, moves the weights.

Counts cover all training documents. A scored document looks up the HEAD most
frequent words in a table of fixed size, and its other words by a join on the
word's hash; such words are rare, so no key of that join is large.

Defined cases: null is the empty text, which is one end token; with no training
documents every count is 0; each row is scored for itself, also when ids repeat or
are null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, crc_mod, keyed, table, utf8, written

OUT = 16  # classes, and slots in each
BEFORE, SKIP, BOTH, SLOT_BEFORE, SLOT_SKIP = 4096, 2048, 8192, 1024, 512  # buckets of each kind of feature
CLASS_KINDS = (BEFORE + 1, SKIP + 1, BOTH)  # one more: nothing stands there
SLOT_KINDS = ((SLOT_BEFORE + 1) * OUT, (SLOT_SKIP + 1) * OUT)
AT = np.cumsum([0, *CLASS_KINDS, *SLOT_KINDS])  # where each kind's rows begin
ROUNDS, RATE, SHARE, SHRINK = 1, 1.0, 0.6, 20.0
UNIT = 1 << 16  # parts of one in which expectations are summed
HEAD = 1 << 18
BLOCK_BYTES, MINIBATCH = 2 << 20, 1 << 15
HELD_WORDS = 1 << 19
PLUS = 0.1

_RANDOM = np.random.default_rng(42).integers(0, 2**64, 256, np.uint64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_CODE = np.where(_SPACE, np.uint64(0), _RANDOM[_LOWER])  # of a byte in a word, lower-cased
_FACTOR = 0x9E3779B97F4A7C15
END = 1  # the hash of an end token


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Block:
    """The tokens of some texts: hash, document and place of each; sizes: tokens of each document."""

    def __init__(self, texts: list[bytes]):
        octets = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = _SPACE[octets]
        begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(octets) else np.empty(0, np.int64)
        if len(begins):
            spans = np.diff(np.append(begins, len(octets)))
            powers = np.ones(int(spans.max()), np.uint64)
            powers[1:] = _FACTOR
            powers = np.cumprod(powers)
            within = np.arange(begins[0], len(octets)) - np.repeat(begins, spans)
            words = _mixed(np.add.reduceat(_CODE[octets[begins[0] :]] * powers[within], begins - begins[0]))
        else:
            words = np.empty(0, np.uint64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(begins, ends)
        counts = np.diff(upto, prepend=0)
        self.sizes = counts + 1
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.doc)) - np.repeat(first, self.sizes)
        self.hash = np.full(len(self.doc), END, np.uint64)
        self.hash[self.place < np.repeat(counts, self.sizes)] = words

    def outcomes(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot of each token."""
        return outcome_of(self.hash)

    def rows(self) -> list[np.ndarray]:
        """The feature row of each kind for each token."""
        of_class, _ = self.outcomes()
        one, two = (np.concatenate([np.zeros(by, np.uint64), self.hash[:-by]])[: len(self.hash)] for by in (1, 2))
        none, none_two = self.place < 1, self.place < 2

        def bucket(h: np.ndarray, size: int, outside: np.ndarray) -> np.ndarray:
            found = (h >> np.uint64(20)).astype(np.int64) % size
            found[outside] = size
            return found

        one[none], two[none_two] = 0, 0
        both = _mixed(one * np.uint64(3) + two)
        return [
            bucket(one, BEFORE, none) + AT[0],
            bucket(two, SKIP, none_two) + AT[1],
            (both >> np.uint64(20)).astype(np.int64) % BOTH + AT[2],
            bucket(one, SLOT_BEFORE, none) * OUT + of_class + AT[3],
            bucket(two, SLOT_SKIP, none_two) * OUT + of_class + AT[4],
        ]


def outcome_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(OUT - 1)).astype(np.int64), (h >> np.uint64(4) & np.uint64(OUT - 1)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts) of blocks of some MB."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BLOCK_BYTES or i + 1 == len(texts):
                yield batch.slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


class Model:
    """weights: outcomes x feature rows; prior: log shares of the classes and, by class, of the slots."""

    def __init__(self, weights: np.ndarray, class_prior: np.ndarray, slot_prior: np.ndarray):
        self.weights, self.class_prior, self.slot_prior = weights, class_prior, slot_prior

    def log_odds(self, rows: list[np.ndarray], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities, outcomes x tokens, of the classes and of the slots of the tokens' classes."""
        out = []
        for kinds, prior in ((rows[:3], self.class_prior[:, None]), (rows[3:], self.slot_prior.T[:, classes])):
            logits = np.empty((OUT, len(classes)), np.float32)
            for c in range(OUT):
                logits[c] = self.weights[c][kinds[0]]
                for r in kinds[1:]:
                    logits[c] += self.weights[c][r]
            logits += prior
            logits -= logits.max(axis=0)
            logits -= np.log(np.exp(logits).sum(axis=0))
            out.append(logits)
        return out[0], out[1]


def first_model(observed: np.ndarray) -> Model:
    """The step from weights of zero. observed: feature rows x outcomes."""
    classes = observed[AT[0] : AT[1]].sum(axis=0)
    slots = observed[AT[3] : AT[4]].reshape(-1, OUT, OUT).sum(axis=0)
    class_share = (classes + 1.0) / (classes.sum() + OUT)
    slot_share = (slots + 1.0) / (slots.sum(axis=1, keepdims=True) + OUT)
    share = np.concatenate([np.broadcast_to(class_share, (AT[3], OUT)), np.tile(slot_share, (int(AT[5] - AT[3]) // OUT, 1))])
    n = observed.sum(axis=1, keepdims=True)
    ratio = (observed + SHRINK * share) / (n + SHRINK) / share
    return Model(np.ascontiguousarray((SHARE * np.log(ratio)).T, np.float32), np.log(class_share).astype(np.float32), np.log(slot_share).astype(np.float32))


def next_model(model: Model, observed: np.ndarray, expected: np.ndarray) -> Model:
    step = RATE * (observed - expected) / (observed + expected + SHRINK)
    return Model(np.ascontiguousarray(model.weights + step.T, np.float32), model.class_prior, model.slot_prior)


def _squeeze(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, n = (np.concatenate(x) for x in zip(*parts))
    found, place = np.unique(hashes, return_inverse=True)
    return found, np.bincount(place, weights=n, minlength=len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: 0, a word's hash and count; 1, a cell (feature row times outcomes, and outcome) and its count."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    cells = np.zeros(int(AT[-1]) * OUT, np.int64)

    def sent(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": np.full(len(key), kind, np.int32), "key": key, "n": n})

    for _, texts in _blocks(batches):
        block = Block(texts)
        found, n = np.unique(block.hash, return_counts=True)
        parts.append((found.view(np.int64), n))
        classes, slots = block.outcomes()
        for kind, (row, a, b) in enumerate(zip(block.rows(), AT, AT[1:])):
            cells[a * OUT : b * OUT] += np.bincount((row - a) * OUT + (classes if kind < 3 else slots), minlength=int(b - a) * OUT)
        if sum(len(p[0]) for p in parts) > HELD_WORDS:
            parts = [_squeeze(parts)]
            if len(parts[0][0]) > HELD_WORDS // 2:
                yield sent(0, *parts.pop())
    if parts:
        yield sent(0, *_squeeze(parts))
    at = np.flatnonzero(cells)
    yield sent(1, at, cells[at])


def _expect(model):
    """What the model expects of each feature row and outcome, in units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((OUT, int(AT[-1])))
        for _, texts in _blocks(batches):
            block = Block(texts)
            rows, (classes, _) = block.rows(), block.outcomes()
            for at in range(0, len(classes), MINIBATCH):
                part = [r[at : at + MINIBATCH] for r in rows]
                for factor, kinds in zip(model.value.log_odds(part, classes[at : at + MINIBATCH]), ((0, 1, 2), (3, 4))):
                    units = np.rint(np.exp(factor) * UNIT).astype(np.float64)
                    for k in kinds:
                        low = int(AT[k])
                        for c in range(OUT):
                            found = np.bincount(part[k] - low, weights=units[c])
                            sums[c, low : low + len(found)] += found
        touched = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_pydict({"feature": touched.astype(np.int32)} | {f"e{c}": sums[c, touched].astype(np.int64) for c in range(OUT)})

    return run


def train_model(train: DataFrame, observed: np.ndarray) -> Model:
    """train: text. observed: feature rows x outcomes."""
    sc = train.sparkSession.sparkContext
    model = first_model(observed)
    schema = "feature int, " + ", ".join(f"e{c} long" for c in range(OUT))
    for _ in range(ROUNDS):
        found = train.mapInArrow(_expect(sc.broadcast(model)), schema).groupBy("feature").agg(*[F.sum(f"e{c}").alias(f"e{c}") for c in range(OUT)]).toArrow()
        expected = np.zeros(observed.shape)
        for c in range(OUT):
            expected[found.column("feature").to_numpy(), c] = found.column(f"e{c}").to_numpy() / UNIT
        model = next_model(model, observed, expected)
    return model


def head_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and counts of the most frequent words: whole classes of count, HEAD words at most."""
    size = F.floor(F.log2("n") * 8).cast("int")
    classes = sorted(((r.size, r["count"]) for r in counts.groupBy(size.alias("size")).count().collect()), reverse=True)
    least, held = None, 0
    for of_size, n in classes:
        held += n
        if held > HEAD:
            break
        least = of_size
    if least is None:
        return np.empty(0, np.int64), np.empty(0)
    top = counts.filter(size >= least).select("word", "n").toArrow()
    words, n = top.column("word").to_numpy(), top.column("n").to_numpy().astype(np.float64)
    order = np.argsort(words)
    return words[order], n[order]


def _score(model, head, log_size):
    """Rows of two kinds: 1, what a document has from the model and the head words, with its place for a word, so that no key holds all documents; 0, its count of another word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = head.value
        log_counts = np.log10(counts + PLUS)
        for batch, texts in _blocks(batches):
            block, size = Block(texts), len(texts)
            rows, (classes, slots) = block.rows(), block.outcomes()
            logs = np.empty(len(classes))
            for at in range(0, len(classes), MINIBATCH):
                of_class, slot = classes[at : at + MINIBATCH], slots[at : at + MINIBATCH]
                a, b = model.value.log_odds([r[at : at + MINIBATCH] for r in rows], of_class)
                each = np.arange(len(slot))
                logs[at : at + MINIBATCH] = a[of_class, each].astype(np.float64) + b[slot, each]
            logs = logs / np.log(10) - log_size.value[classes, slots]
            words = block.hash.view(np.int64)
            at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
            inside = known[at] == words if len(known) else np.zeros(len(words), bool)
            log_count = np.where(inside, log_counts[at], 0.0) if len(known) else np.zeros(len(words))
            places = [batch.column(c) for c in ROW]
            total = lambda values: np.bincount(block.doc, weights=values, minlength=size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(size, np.int32)), places[1], *places, batch.column("id"), pa.array(block.sizes), pa.array(total(logs)), pa.array(total(log_count)), pa.array(total(inside).astype(np.int64))],
                names=PARTS,
            )
            rest = np.flatnonzero(~inside)
            order = rest[np.lexsort((words[rest], block.doc[rest]))]
            new = np.flatnonzero(np.concatenate([[True], (words[order[1:]] != words[order[:-1]]) | (block.doc[order[1:]] != block.doc[order[:-1]])])) if len(order) else order
            n = np.diff(np.append(new, len(order)))
            doc = pa.array(block.doc[order[new]])
            none, zero = pa.nulls(len(n), pa.int64()), pa.array(np.zeros(len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(words[order[new]]), *[p.take(doc) for p in places], none, pa.array(n), zero, zero, none], names=PARTS)

    return run


PARTS = ["kind", "word", *ROW, "id", "n", "model", "counted", "known"]


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs, learning from train; and the rows' places (ROW)."""
    sc = docs.sparkSession.sparkContext
    rows = keyed(docs).select(F.col(id_col).cast("long").alias("id"), *ROW, utf8(F.col(text_col)).alias("text"))
    train = train.select(utf8(F.col(text_col)).alias("text"))
    found = written(train.mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    counts = found.filter("kind = 0").select(F.col("key").alias("word"), "n")
    cells = found.filter("kind = 1").select("key", "n").toArrow()  # one row for each cell of tables of fixed size
    observed = np.zeros(int(AT[-1]) * OUT)
    observed[cells.column("key").to_numpy()] = cells.column("n").to_numpy()
    observed = observed.reshape(-1, OUT)
    outcome = F.col("word").bitwiseAND(OUT * OUT - 1).cast("int")
    sizes = counts.groupBy(outcome.alias("outcome")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    total, words = sum(r.n for r in sizes), sum(r.words for r in sizes)
    log_size = np.full((OUT, OUT), np.log10(PLUS))
    for r in sizes:
        log_size[r.outcome % OUT, r.outcome // OUT] = np.log10(r.n + PLUS * (r.words + 1))
    head = sc.broadcast(head_words(counts))
    model = sc.broadcast(train_model(train, observed))
    schema = "kind int, word long, __file long, __row long, id long, n long, model double, counted double, known long"
    parts = rows.mapInArrow(_score(model, head, sc.broadcast(log_size)), schema)
    rare = counts.select(F.lit(0).alias("kind"), "word", F.col("n").alias("c"))
    c = F.coalesce(F.col("c"), F.lit(0))
    own = F.col("kind") == 1
    looked = parts.join(rare, ["kind", "word"], "left").select(
        *ROW,
        "id",
        F.when(own, F.col("n")).otherwise(0).alias("n_tokens"),
        F.when(own, F.col("known")).otherwise(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.when(own, F.col("counted")).otherwise(F.col("n") * F.log10(c + PLUS)).alias("counted"),
        "model",
    )
    summed = looked.groupBy(*ROW).agg(F.max("id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "counted", "model")])
    base = float(np.log10(total + PLUS * (words + 1)))
    return summed.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("counted") + F.col("model")).alias("score"),
        *ROW,
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    return score(docs, docs.filter(~held)).withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
