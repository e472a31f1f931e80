"""URL filtering by a memory-mapped sorted digest array.

Rules (host, path, verdict) become entries: each rule's host with its path, and each
host with the lengths of its rules' paths. Entries are dealt by ranges of their 64-bit
xxhash; each range is sorted and written as one file in the shared folder: the keys,
where each stored string begins, the strings, the payloads. Spark hands the files to
every executor, whose tasks map them into memory, so that they take pages and no heap,
however long the list is. A batch of urls probes with vectorised binary searches: the
endings of its hosts first, then, for hosts that are stored, the beginnings of its paths
of the lengths stored there. A key that is found counts only where the stored string is
the same.

A rule fits its host and all subdomains, if the path begins with the rule's; the longest
rule (host and path together) wins, of rules as long one that blocks, then that with the
longer host. What no rule fits is allowed: the array lists what is
known, and says nothing of the rest.

Defined cases: a null url, or one without `://`, has empty host and path, which no rule
with a host fits; no rows give no rows; repeated rows each have their verdict; rules
without a host, or with a path that no url can have, are ignored, null paths count as
empty; of equal rules with different verdicts the one that blocks counts; no rules at
all allow everything; other columns are ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import shared_dir, table

#: The rules of the query (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
VERDICTS = ["", "allow", "block"]
OTHERWISE = "allow"
FILE_ENTRIES = 20_000_000  # of one file of the array


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; empty without `://`."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substr(text, F.instr(text, "://") + F.lit(3))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _digests(strings: list[bytes], bits: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, seed=42) for s in strings), np.uint64, len(strings)) >> np.uint64(64 - bits)


def _entries(rules: DataFrame, bits: int) -> DataFrame:
    """key, text, verdict (0: no rule), lengths (of the paths stored for a host)."""
    host = F.translate(F.col("host").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.filter("host <> '' AND (path IS NULL OR path = '' OR path LIKE '/%')").select(host.alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    code = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).cast("int") - 1
    whole = rules.groupBy(F.concat("host", "path").alias("text")).agg(F.max(code).alias("verdict")).withColumn("lengths", F.array().cast("array<int>"))
    hosts = rules.groupBy(F.col("host").alias("text")).agg(F.lit(0).alias("verdict"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    both = whole.unionByName(hosts).groupBy("text").agg(F.max("verdict").alias("verdict"), F.max("lengths").alias("lengths"))
    return both.select(F.shiftrightunsigned(F.xxhash64("text"), 64 - bits).alias("key") if bits < 64 else F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"), "verdict", "lengths")


_FILE = "name string, labels int, first string, last string"


def _write(folder: str):
    """Sorts one range of entries and writes it as a file: counts, keys, string ends, verdicts, length ends, lengths, strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        keys = rows.column("key").to_numpy().view(np.uint64)
        texts = rows.column("text").to_pylist()
        order = np.array(sorted(range(len(texts)), key=lambda i: (keys[i], texts[i])))
        texts, lengths = [texts[i] for i in order], [rows.column("lengths")[int(i)].as_py() for i in order]
        keys, verdicts = keys[order], rows.column("verdict").to_numpy()[order]
        blob, flat = b"".join(texts), np.array([x for own in lengths for x in own], np.int64)
        arrays = [keys, np.cumsum([0, *map(len, texts)]), verdicts.astype(np.int64), np.cumsum([0, *map(len, lengths)]), flat]
        name = f"digests-{uuid.uuid4().hex}"
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        with files.open_output_stream(f"{base}/{name}") as out:
            out.write(np.array([len(keys), len(flat), len(blob)], np.int64).tobytes())
            for a in arrays:
                out.write(np.ascontiguousarray(a).tobytes())
            out.write(blob)
        labels = max((t.count(b".") + 1 for t, own in zip(texts, lengths) if own), default=0)
        yield pa.RecordBatch.from_pydict({"name": [name], "labels": pa.array([labels], pa.int32()), "first": [str(keys[0])], "last": [str(keys[-1])]})

    return run


class Mapped:
    """One file of the array, mapped into memory."""

    def __init__(self, path: str):
        head = np.memmap(path, np.int64, "r", shape=(3,))
        n, flat, blob = map(int, head)
        at = 24
        parts = []
        for kind, size in ((np.uint64, n), (np.int64, n + 1), (np.int64, n), (np.int64, n + 1), (np.int64, flat), (np.uint8, blob)):
            parts.append(np.memmap(path, kind, "r", at, (size,)) if size else np.empty(0, kind))
            at += 8 * size
        self.keys, self.ends, self.verdicts, self.length_ends, self.lengths, self.blob = parts

    def find(self, keys: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """The entry of each text, or -1: the first with its key, then the next ones while the key is the same and the stored string is not."""
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_ := open_[self.keys[at[open_]] == keys[open_]]):
            same = np.array([self.blob[self.ends[at[i]] : self.ends[at[i] + 1]].tobytes() == texts[i] for i in open_])
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.keys)]
        return out


@functools.lru_cache(maxsize=None)
def _mapped(name: str) -> Mapped:
    return Mapped(SparkFiles.get(name))


class DigestArray:
    """Where the files of the array are; what tasks probe."""

    def __init__(self, files: list[tuple[str, int, int]], labels: int, bits: int):
        self.files, self.labels, self.bits = files, labels, bits

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(place in texts, verdict, lengths) of each text that is stored."""
        keys = _digests(texts, self.bits)
        for name, first, last in self.files:
            mine = np.flatnonzero((keys >= np.uint64(first)) & (keys <= np.uint64(last)))
            if len(mine):
                file = _mapped(name)
                for i, e in zip(mine, file.find(keys[mine], [texts[i] for i in mine])):
                    if e >= 0:
                        yield int(i), int(file.verdicts[e]), file.lengths[file.length_ends[e] : file.length_ends[e + 1]]

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """Rule and verdict of each host and path."""
        known: dict[str, int] = {}
        of_host = [known.setdefault(h, len(known)) for h in hosts]
        ends, owners = [], []
        for host, k in known.items():
            parts = host.rsplit(".", self.labels)[-self.labels :] if self.labels and host else []
            for i in range(len(parts)):
                ends.append(".".join(parts[i:]))
                owners.append(k)
        stored: dict[int, list[tuple[str, np.ndarray]]] = {}
        for i, _, lengths in self.find([e.encode() for e in ends]):
            stored.setdefault(owners[i], []).append((ends[i], lengths))
        tried: dict[str, list[int]] = {}
        for row, (k, path) in enumerate(zip(of_host, paths)):
            for end, lengths in stored.get(k, ()):
                for n in lengths:
                    if n <= len(path):
                        tried.setdefault(end + path[:n], []).append(row)
        best: list[tuple[int, int, int, str | None]] = [(-1, VERDICTS.index(OTHERWISE), 0, None)] * len(hosts)
        texts = list(tried)
        for i, verdict, _ in self.find([t.encode() for t in texts]):
            found = (len(texts[i]), verdict, len(texts[i].partition("/")[0]), texts[i])
            for row in tried[texts[i]] if verdict else ():
                best[row] = max(best[row], found, key=lambda x: x[:3])
        return [b[3] for b in best], [VERDICTS[b[1]] for b in best]


def build(rules: DataFrame, bits: int = 64, file_entries: int = FILE_ENTRIES) -> DigestArray:
    """rules: host, path, verdict (allow or block). bits: of the digests that are kept; fewer ones make more collisions, and the same answers."""
    spark = rules.sparkSession
    folder = shared_dir(spark)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    entries = _entries(rules, bits)
    n = max(1, -(-entries.count() // file_entries))
    ranged = entries.repartitionByRange(n, F.col("key").bitwiseXOR(F.lit(-(2**63))))  # as unsigned
    files = ranged.mapInArrow(_write(folder), _FILE).collect()  # one row for each file
    for f in files:
        spark.sparkContext.addFile(f"{folder}/{f['name']}")
    return DigestArray([(f["name"], int(f["first"]), int(f["last"])) for f in files], max((f["labels"] for f in files), default=0), bits)


def judged(urls: DataFrame, array: DigestArray, url_col: str = "url", out_col: str = "judged") -> DataFrame:
    """urls with a struct column: host, path, rule, verdict."""

    @arrow_udf("struct<rule: string, verdict: string>")
    def verdict(host: pa.Array, path: pa.Array) -> pa.Array:
        rules, verdicts = array.judge(host.to_pylist(), path.to_pylist())
        return pa.StructArray.from_arrays([pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["rule", "verdict"])

    host, path = host_and_path(F.col(url_col))
    found = verdict(host, path)
    return urls.withColumn(out_col, F.struct(host.alias("host"), path.alias("path"), found["rule"].alias("rule"), found["verdict"].alias("verdict")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = build(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    return judged(table(spark, sf_dir, "pages"), array).select("page_id", "judged.*")


_VALUES = ", ".join(str(r) for r in RULES)
ORACLE = rf"""
WITH rules(h, p, v) AS (VALUES {_VALUES}),
u AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (SELECT row, h || p AS rule, v FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(h || p) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, '{OTHERWISE}') AS verdict FROM s LEFT JOIN fit USING (row)
"""
