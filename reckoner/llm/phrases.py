"""Phrase collocations from an FM-index for each shard of words.

Input tasks turn their texts into word ids, a shard for each language; small shards of
a language are then joined, in the order of their tasks, to shards of about SHARD_WORDS
words, which share more of their counts than small ones. For each shard an FM-index is built over word ids, sorted only as
deep as the longest phrase; its intervals are extended by one word to the left in
the index of the text, or to the right in the index of the reversed text, in step
in both, which enumerates the shard's n-grams with their counts. Counts are summed
across shards.

A shard enumerates only what can still be frequent: pairs of words that are frequent
over all shards, then triples and quadruples in runs of such pairs. What is frequent
goes back to the shards in which it occurs, keyed by shard, so that no list of all
frequent phrases is held anywhere.

A phrase is dropped when a longer candidate around it is nearly as frequent; since
counts only fall as phrases grow, its extensions by one word decide that.

Defined cases: null text counts as empty, null language as `und`; no rows give no
rows; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, utf8, written

LEAST = 30  # occurrences of a candidate
WORDS = 4  # of the longest candidate
COVERED = 80  # percent of a phrase's occurrences that lie in one longer candidate
TOP = 2000
SHARD_WORDS = 1 << 21
NEAR_TASKS = 1024  # input tasks whose shards may be joined
BODY_BYTES = 4 << 20  # texts that are split at once
SALTS = 64  # parts of a language that are ranked apart first

#: Bytes that end a piece, bytes that end a word.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TRANSLATED = bytes.maketrans(PIECE_ENDS + WORD_ENDS, b"\n" * len(PIECE_ENDS) + b" " * len(WORD_ENDS))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)).translate(_TRANSLATED)
END = -1  # stands between pieces


class Shard:
    """Word ids of one language's texts, END between pieces."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        body = b"\n".join(texts).translate(_LOWER).replace(b"\n", b" \n ")
        coded = pc.split_pattern(pa.array([body], pa.large_binary()), b" ").flatten().dictionary_encode()
        own = np.array([END if w == b"\n" else -2 if not w else self.ids.setdefault(w, len(self.ids)) for w in coded.dictionary.to_pylist()], np.int32)
        codes = own[coded.indices.to_numpy()]
        codes = codes[codes != -2]
        self.codes += [codes, np.array([END], np.int32)]
        self.size += len(codes) + 1

    def row(self, lang: str, number: int) -> tuple:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes[codes != END], minlength=len(self.ids))
        return lang, number, list(self.ids), counts.tolist(), int(counts.sum()), zstandard.compress(codes.tobytes())


_SHARD = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("n_words", pa.int64()), ("codes", pa.binary())])
_SHARD_DDL = "lang string, shard long, words array<binary>, counts array<long>, n_words long, codes binary"


def _encode(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        open_: dict[str, Shard] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            row = open_.pop(lang).row(lang, first + number)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARD)], schema=_SHARD)

        for batch in batches:
            langs, body = batch.column("lang").to_pylist(), batch.column("body")
            waiting: dict[str, list[bytes]] = {}
            held = 0
            for i, lang in enumerate(langs):
                text = body[i].as_py()
                waiting.setdefault(lang, []).append(text)
                held += len(text) + 1
                if held >= BODY_BYTES or i == len(langs) - 1:
                    for key, texts in waiting.items():
                        open_.setdefault(key, Shard()).add(texts)
                    waiting, held = {}, 0
                    while sum(s.size for s in open_.values()) >= shard_words:
                        yield closed(max(open_, key=lambda key: open_[key].size))
        for lang in list(open_):
            yield closed(lang)

    return run


def _join(key, parts):
    """Shards of one language as one, under the smallest of their numbers."""
    whole = Shard()
    for words, codes in zip(parts.column("words"), parts.column("codes")):
        own = np.array([*(whole.ids.setdefault(w, len(whole.ids)) for w in words.as_py()), END], np.int32)  # END, -1, finds the last
        whole.codes.append(own[np.frombuffer(zstandard.decompress(codes.as_py()), np.int32)])
    row = whole.row(parts.column("lang")[0].as_py(), min(parts.column("shard").to_pylist()))
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARD)], schema=_SHARD)


def shards_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each shard: its words, their counts, and its texts as word ids."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), utf8(F.col(text_col)).alias("body"))
    small = written(texts.mapInArrow(_encode(shard_words), _SHARD_DDL), "small-shards")
    near = Window.partitionBy("lang", F.shiftright("shard", 32 + NEAR_TASKS.bit_length() - 1)).orderBy("shard")
    before = F.sum("n_words").over(near) - F.col("n_words")
    places = small.select("lang", "shard", "n_words").select("shard", F.shiftright("shard", 32 + NEAR_TASKS.bit_length() - 1).alias("near"), F.floor(before / shard_words).alias("part"))
    joined = small.join(places, "shard").groupBy("lang", "near", "part").applyInArrow(_join, _SHARD_DDL)
    return written(joined, "shards")


class FmIndex:
    """Of a text of symbols from 1 up, 0 between runs and at the end. Intervals are right for patterns of up to `depth` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        rank, width, order = text, 1, np.argsort(text, kind="stable")
        while width < depth:
            key = (rank << 32) | np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            step = np.empty(len(key), np.int64)
            step[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0]) if len(key) else 0
            rank, width = step, width * 2
        self.bwt = text[order - 1]
        self.back = np.empty(len(text), np.int64)  # from a suffix to the one that starts a symbol earlier
        self.back[np.argsort(self.bwt, kind="stable")] = np.arange(len(text))

    def extended(self, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All intervals that are one symbol longer: the interval each comes from, its symbol, low and count, and how many of the old interval's symbols are smaller."""
        of = np.repeat(np.arange(len(low)), count)
        begins = np.cumsum(count) - count
        place = np.arange(len(of)) + np.repeat(low - begins, count)
        key = (of << 32) | self.bwt[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        n = np.diff(np.r_[at, len(key)])
        of, symbol = key[at] >> 32, key[at] & 0xFFFFFFFF
        real = symbol > 0
        return of[real], symbol[real], self.back[place[order[at]]][real], n[real], (at - begins[of])[real]


def ngrams(text: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 2 to longest: the n-grams of a text (rows of symbols) and their counts, by intervals in the index of the text and, in step, of the text reversed."""
    if not len(text):
        return
    ahead = FmIndex(text, longest)
    behind = FmIndex(text[::-1].copy() if longest > 2 else text[:0], longest)
    n = np.bincount(text)
    grams = np.flatnonzero(n[1:])[:, None] + 1
    low = (np.cumsum(n) - n)[grams[:, 0]]
    low_back, n = low.copy(), n[grams[:, 0]]
    for length in range(2, longest + 1):
        if length % 2 == 0:
            of, symbol, new, n, smaller = ahead.extended(low, n)
            low, low_back = new, low_back[of] + smaller
            grams = np.c_[symbol, grams[of]]
        else:
            of, symbol, new, n, smaller = behind.extended(low_back, n)
            low, low_back = low[of] + smaller, new
            grams = np.c_[grams[of], symbol]
        yield grams, n


def runs(codes: np.ndarray, word: np.ndarray, pairs: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least `least` words, all of them marked in `word` and all neighbours in `pairs` (sorted, first << 32 | second), as symbols with 0 after each run; and the word id of each symbol."""
    fine = (codes != END) & word[codes]
    near = fine[:-1] & fine[1:]
    if pairs is not None:
        key = (codes[:-1].astype(np.int64) << 32) | codes[1:]
        at = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
        near &= (pairs[at] == key) if len(pairs) else False
    run = np.cumsum(np.r_[0, ~near]) if len(codes) else np.empty(0, np.int64)
    kept = np.flatnonzero(fine & (np.bincount(run)[run] >= least)) if len(codes) else np.empty(0, np.int64)
    used = np.flatnonzero(np.bincount(codes[kept], minlength=len(word)))
    symbol = np.zeros(len(word), np.int64)
    symbol[used] = np.arange(1, len(used) + 1)
    ends = np.r_[run[kept][1:] != run[kept][:-1], True] if len(kept) else np.empty(0, bool)
    text = np.zeros(len(kept) + int(ends.sum()), np.int64)
    text[np.arange(len(kept)) + np.cumsum(np.r_[0, ends[:-1]]) if len(kept) else kept] = symbol[codes[kept]]
    return text, np.r_[-1, used]


_ROW = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("phrase", pa.binary()), ("words", pa.int32()), ("n", pa.int64())])
_ROW_DDL = "lang string, shard long, phrase binary, words int, n long"


def _grams(lengths: range):
    """Of a shard and the phrases, one word shorter than lengths begin, that are frequent over all shards and occur in it."""

    def run(key, shard: pa.Table, frequent: pa.Table) -> pa.Table:
        if not len(shard) or not len(frequent):
            return _ROW.empty_table()
        words = shard.column("words").chunk(0).flatten()
        codes = np.frombuffer(zstandard.decompress(shard.column("codes")[0].as_py()), np.int32)
        known = frequent.column("phrase").combine_chunks()
        parts = pc.split_pattern(known, b" ").flatten()
        place = pc.index_in(parts, value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        marked = np.zeros(len(words) + 1, bool)  # the last one stands for END
        marked[place] = True
        pairs = np.sort((place[0::2] << 32) | place[1::2]) if lengths[0] > 2 else None
        text, word_of = runs(codes, marked, pairs, lengths[0])
        out = []
        for grams, n in ngrams(text, lengths[-1]):
            if grams.shape[1] in lengths:
                texts = pc.binary_join_element_wise(*(words.take(pa.array(word_of[column])) for column in grams.T), pa.scalar(b" ", pa.binary()))
                same = [pa.repeat(shard.column(c)[0], len(n)) for c in ("lang", "shard")]
                out.append(pa.Table.from_arrays([*same, texts.cast(pa.binary()), pa.repeat(pa.scalar(grams.shape[1], pa.int32()), len(n)), pa.array(n, pa.int64())], schema=_ROW))
        return pa.concat_tables(out) if out else _ROW.empty_table()

    return run


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """The rows (lang, shard, phrase, n) of phrases that occur often enough over all shards."""
    of = Window.partitionBy("lang", "phrase")
    return rows.withColumn("total", F.sum("n").over(of)).filter(F.col("total") >= least).drop("total")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))


def phrase_counts(shards: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase (bytes), words, f of every phrase of up to WORDS words with f >= least."""
    entry = F.explode(F.arrays_zip(F.col("words"), F.col("counts"))).alias("entry")
    single = shards.select("lang", "shard", entry).select("lang", "shard", F.col("entry.words").alias("phrase"), F.lit(1).alias("words"), F.col("entry.counts").alias("n"))
    single = written(_frequent(single, least), "words")
    texts = shards.select("shard", "lang", "words", "codes").groupBy("shard")
    pairs = written(_frequent(texts.cogroup(single.select("shard", "phrase").groupBy("shard")).applyInArrow(_grams(range(2, 3)), _ROW_DDL), least), "pairs")
    longer = texts.cogroup(pairs.select("shard", "phrase").groupBy("shard")).applyInArrow(_grams(range(3, WORDS + 1)), _ROW_DDL)
    longer = _summed(longer).filter(F.col("f") >= least)
    return written(_summed(single.unionByName(pairs)).unionByName(longer), "counts")


def _ranked(df: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return df.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language by their weakest cut."""
    shards = shards_of(docs, text_col, lang_col, shard_words)
    f = phrase_counts(shards, least)
    n = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    phrases = f.filter("words > 1").select("lang", F.col("phrase").cast("string").alias("phrase"), "words", F.col("f").alias("a"))
    parts = f.filter(f"words < {WORDS}").select("lang", F.col("phrase").cast("string").alias("part"), "f")
    word = F.split("phrase", " ")
    tail = F.array_join(F.slice(word, 2, F.col("words") - 1), " ")
    head = F.array_join(F.slice(word, 1, F.col("words") - 1), " ")
    around = phrases.filter("words > 2").select("lang", F.explode(F.array(head, tail)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    big = "decimal(20,0)"
    covered = F.lit(100).cast("decimal(3,0)") * F.col("longer").cast(big) >= F.lit(COVERED).cast("decimal(3,0)") * F.col("a").cast(big)
    kept = phrases.join(around, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice(word, 1, F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(CAST(2000000 AS decimal(7,0)) * CAST(a AS decimal(20,0))) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = _ranked(_ranked(scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), ["lang", "salt"], top).drop("rank", "salt"), ["lang"], top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_GRAM = "\n  UNION ALL ".join(f"SELECT lang, {m} AS words, array_to_string(w[i:i + {m - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM p)" for m in range(1, WORDS + 1))
ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
      FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM d)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM (
  {_GRAM}) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words > 1 AND f >= {LEAST}),
longer AS (SELECT lang, phrase, max(a) AS a FROM (
  SELECT lang, a, array_to_string(w[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(1, words)) AS i FROM c) JOIN range(2, {WORDS + 1}) t(j) ON i < j AND j <= words AND j - i + 1 < words) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < {COVERED} * c.a),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM kept)),
s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f + y.f) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low) JOIN n USING (lang)
WHERE rank <= {TOP}
"""
