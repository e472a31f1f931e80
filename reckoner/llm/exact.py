"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after each run of ASCII white space became one
space. Each input task inserts its texts, as whole byte strings, into a
compressed radix trie whose terminals keep the smallest row and a count, and sends
each different text once, under a key of the task's own; every row keeps the key
of its terminal. Texts are then dealt by byte length and content hash; there the
owner of a (length, hash) inserts what the tasks sent into a trie of its own and
answers each key with the smallest row and the count over all. So a text with very
many copies crosses the shuffle once for each input task, and its rows learn their
owner by their task's key, which no more rows share than the task read. When a
trie holds more than its budget of bytes, its largest subtrees are spilled: a task
sends them early, and the owners merge what comes twice; an owner, which must see
all of a key, holds only the different texts of one length and hash.

Defined cases: null counts as empty; of equal texts the smallest id stays, a null
id after all others, and of rows with that id the first in the table: one row for
each text, also when ids repeat; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, keyed, table, written

BUDGET_BYTES = 48 << 20
SENT_AT_ONCE = 8 << 20
NO_ID = 2**63 - 1  # stands for a null id while the tries work
#: Runs of [\x20\x09-\x0D] other than a lone space, which is already what it becomes.
RUNS = r"[\t-\x0d][\t-\x0d ]*| [\t-\x0d ]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), RUNS, " ")


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    lo, hi = 0, min(len(a), len(b) - at)
    if a[:hi] == b[at : at + hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid
    return lo


#: A row among others: its id, file and place. Smaller ones stay.
Row = tuple[int, int, int]


class Trie:
    """Compressed radix trie over byte strings. A node: [label, children by first byte, smallest row or None, count, key]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, 0, 0]
        self.held = 0
        self.keys = 0

    def add(self, text: bytes, smallest: Row, count: int) -> int:
        """The key of the text's terminal."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None, 0, 0]
                self.held += len(text) - at + 250
                at = len(text)
            else:
                label = child[0]
                same = _shared(label, text, at)
                at += same
                if same < len(label):
                    upper = [label[:same], {label[same]: child}, None, 0, 0]
                    child[0] = label[same:]
                    node[1][label[0]] = upper
                    self.held += 250
                    child = upper
            node = child
        if node[2] is None:
            self.keys += 1
            node[2:] = smallest, count, self.keys
        else:
            node[2], node[3] = min(node[2], smallest), node[3] + count
        return node[4]

    def terminals(self, node: list, prefix: bytes = b"") -> Iterator[tuple[bytes, Row, int, int]]:
        """(text, smallest row, count, key) below a node."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node[0]
            if node[2] is not None:
                yield prefix, *node[2:]
            stack += [(child, prefix) for child in node[1].values()]

    def spill(self) -> Iterator[tuple[bytes, Row, int, int]]:
        """Gives up the subtrees with most bytes until half the held bytes are left."""

        def weight(node: list) -> int:
            total, stack = 0, [node]
            while stack:
                x = stack.pop()
                total += len(x[0]) + 250
                stack += x[1].values()
            return total

        sizes = {first: weight(child) for first, child in self.root[1].items()}
        left = sum(sizes.values())
        target = left // 2
        for first in sorted(sizes, key=sizes.get, reverse=True):
            if left <= target:
                break
            yield from self.terminals(self.root[1].pop(first))
            left -= sizes[first]
        self.held = left


_ROW_TYPES = [("id", pa.int64()), ("file", pa.int64()), ("row", pa.int64())]
#: A text as a task sends it, or (body null) a row of that task with the key of its text.
_TASK = pa.schema([("body", pa.binary()), ("task", pa.int64()), ("key", pa.int64()), *_ROW_TYPES, ("n", pa.int64())])
_ANSWER = pa.schema([("task", pa.int64()), ("key", pa.int64()), ("sha", pa.string()), *_ROW_TYPES, ("n", pa.int64())])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0]) + 50 if isinstance(row[0], bytes) else 100
        if size >= SENT_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _task_tries(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        trie = Trie()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                places = zip(*(batch.column(c).to_pylist() for c in ("id", *ROW)))
                body = batch.column("body")
                for i, place in enumerate(places):
                    key = trie.add(body[i].as_py(), place, 1)
                    yield None, task, key, *place, 1
                    if trie.held > budget:
                        for text, first, n, own in trie.spill():
                            yield text, task, own, *first, n
            for text, first, n, own in trie.terminals(trie.root):
                yield text, task, own, *first, n

        yield from _batches(rows(), _TASK)

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length and hash; one trie for each pair of them."""

    def answers(trie: Trie, asked: list[tuple[int, int, int]]) -> Iterator[tuple]:
        found = {key: (hashlib.sha256(text).hexdigest(), *first, n) for text, first, n, key in trie.terminals(trie.root)}
        for task, key, own in asked:
            yield task, key, *found[own]

    def rows() -> Iterator[tuple]:
        now, trie, asked = None, Trie(), []
        for batch in batches:
            body = batch.column("body")
            for i, (size, code, task, key, *first, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "hash", "task", "key", "id", "file", "row", "n")))):
                if (size, code) != now:
                    yield from answers(trie, asked)
                    now, trie, asked = (size, code), Trie(), []
                asked.append((task, key, trie.add(body[i].as_py(), tuple(first), n)))
        yield from answers(trie, asked)

    yield from _batches(rows(), _ANSWER)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_bytes: int = BUDGET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs, and its place (ROW), by which keyed(docs) has it."""
    return groups_of(keyed(docs), id_col, text_col, budget_bytes)


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_bytes: int = BUDGET_BYTES) -> DataFrame:
    """As exact_groups, for docs with the columns ROW."""
    bodies = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), *ROW, normalised(F.col(text_col)).cast("binary").alias("body"))
    sent = written(bodies.mapInArrow(_task_tries(budget_bytes), _ddl(_TASK)), "tries")
    texts = sent.filter("body IS NOT NULL").withColumn("n_bytes", F.octet_length("body")).withColumn("hash", F.xxhash64("body"))
    answers = texts.repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash").mapInArrow(_owners, _ddl(_ANSWER))
    named = answers.select("task", "key", F.col("sha").alias("text_sha256"), F.col("id").alias("keep"), F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    same = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return (
        sent.filter("body IS NULL")
        .select("task", "key", "id", "file", "row")
        .join(named, ["task", "key"])
        .select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.nullif("keep", F.lit(NO_ID)).alias("keep_id"), "group_size", same.alias("kept"), "text_sha256", F.col("file").alias(ROW[0]), F.col("row").alias(ROW[1]))
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop(*ROW)


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
