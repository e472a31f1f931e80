import math
import re

import zstandard as zstd
from pyspark.sql import functions as F
from reckoner.llm import langid as L
from reckoner.llm.common import crc_mod


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    share = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.95


def test_cases(spark):
    english = "the cat sat on the mat and the dog ate the bone with a long red tail "
    german = "der hund und die katze schlafen nicht weil das haus sehr klein ist "
    rows = [(i, (english if i % 2 else german) * (1 + i % 3), "en" if i % 2 else "de", 5) for i in range(40)]
    rows += [(100, None, "en", 1), (101, "", "en", 1), (102, "123 !?", "en", 1), (103, german * 3000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = L.fit(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: r.predicted for r in L.annotate(docs, model).collect()}
    assert len(got) == 44 and all(0 <= p.score <= 1 for p in got.values())
    assert all(got[i].lang == "und" and not got[i].accepted for i in (100, 101, 102))
    assert got[103].lang == "de" and got[1].lang == "en" and got[2].lang == "de" and got[1].accepted
    empty = docs.limit(0)
    assert L.fit(empty) == [] and L.annotate(empty, []).collect() == []
    assert {r.predicted.lang for r in L.annotate(docs, []).collect()} == {"und"}


def brute(model, text):
    """The contract's columns by the docstring, one text at a time, without the operator's code."""
    text = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", (text or "").lower(), flags=re.S)
    text = " ".join(text.split()).encode()
    if not text or not model:
        return "und", 0.0, False

    def size(words, level, **more):
        params = zstd.ZstdCompressionParameters.from_level(level, source_size=4096, dict_size=len(words), write_content_size=False, write_checksum=False, write_dict_id=False, **more)
        c = zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(words, dict_type=zstd.DICT_TYPE_RAWCONTENT))
        return sum(len(c.compress(text[i : i + 4096])) for i in range(0, len(text), 4096))

    sizes = {lang: size(words, 6) for lang, words in model}
    if len(sizes) > 1 and sorted(sizes.values())[1] - min(sizes.values()) <= max(2, 0.01 * len(text)):
        sizes = {lang: size(words, 19, min_match=3) for lang, words in model}
    first = min(sizes, key=sizes.get)
    second = min([v for lang, v in sizes.items() if lang != first], default=math.inf)
    return first, 1 / sum(math.exp(sizes[first] - v) for v in sizes.values()), second - sizes[first] > 0.02 * sizes[first]


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionAll(docs.limit(20)).unionAll(spark.createDataFrame([(None, "der hund", "de"), (-1, None, None), (-2, "x", "en"), (-2, "x", "en")], docs.schema))
    model = L.fit(docs.filter(F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(True))))
    assert {len(words) for _, words in model} <= {L.DICT_BYTES} or len(model) == 4
    rows = L.annotate(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        lang, score, accepted = brute(model, r.text)
        assert (r.predicted.lang, r.predicted.accepted) == (lang, accepted) and abs(r.predicted.score - score) < 1e-9


def test_unlearned_languages_are_rejected(spark):
    """A language that no dictionary knows has narrow margins; learned ones do not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.length("text") > 300)
    model = L.fit(docs.filter("lang <> 'es'"))
    share = dict(L.annotate(docs, model).groupBy("lang").agg(F.avg(F.col("predicted.accepted").cast("int"))).collect())
    assert share["es"] < 0.15 and min(share["en"], share["de"], share["fr"]) > 0.95


def test_short_dictionaries_count(spark):
    docs = spark.createDataFrame([(1, "abc", "x"), (2, "wordy words of another kind", "y"), (3, "abc", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.predicted.lang for r in L.annotate(docs, L.fit(docs)).collect()}
    assert set(got.values()) <= {"x", "y"} and "und" not in got.values()
