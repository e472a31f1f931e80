"""Language identification by compression.

For each language a zstandard raw-content dictionary holds a bounded sample of
labelled texts. A text, as lower-case letters and single spaces, is compressed
with every dictionary in pieces of PIECE bytes, all of it, and the language with
the smallest total wins. Where the two best are close, the text is compressed
again with a slower setting that finds shorter matches; languages still level are
settled in favour of the one with more training documents. A text whose margin
stays at or under NARROW of its smallest size is rejected, whatever its length; so
is every tie.

The sample: for each language up to SAMPLE_DOCS labelled texts in the order of a
hash of their id, those of 200 to 2048 bytes first, and DICT_BYTES of them.

Defined cases: null text or text without a letter gives `und`, score 0, rejected;
with no labelled training text every document is `und`; a null lang is not
learned from; with one learned language nothing is narrow; repeated rows each get
their result, the same; other columns are ignored (annotate keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import crc_mod, table

SAMPLE_DOCS = 160
DICT_BYTES = 65_536
PIECE = 4096
LEVEL, FINE_LEVEL = 6, 19
FINE_BELOW = 0.01  # of a text's bytes: a closer margin is measured again
NARROW = 0.02  # of the smallest size: a margin that rejects
LEAST_BYTES = 8  # a dictionary that is shorter is filled up with spaces
UNKNOWN = "und"
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def letters(text: Column) -> Column:
    """Lower-case letters, each other run one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+", " "))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, bytes]]:
    """(language, dictionary), languages with more documents first. docs: the rows to learn from."""
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = F.octet_length("text")
    order = [(~size.between(200, 2048)).cast("int"), F.xxhash64("id"), F.col("id")]
    picked = (
        known.filter(F.col("text").isNotNull())
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .filter(F.col("place") <= SAMPLE_DOCS)
        .select("lang", "place", F.substring(letters(F.col("text")), 1, DICT_BYTES).alias("text"))
    )
    texts: dict[str, list] = {}
    for row in picked.collect():
        texts.setdefault(row.lang, []).append((row.place, row.text))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    model = []
    for lang in sorted(texts, key=lambda x: (-counts[x], x)):
        whole = " ".join(t for _, t in sorted(texts[lang]) if t).encode()[:DICT_BYTES]
        if whole:
            model.append((lang, whole.ljust(LEAST_BYTES)))
    return model


def _compressors(model: list[tuple[str, bytes]], level: int, **more) -> list:
    out = []
    for _, content in model:
        shared = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        params = zstd.ZstdCompressionParameters.from_level(level, source_size=PIECE, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, **more)
        shared.precompute_compress(compression_params=params)
        out.append(zstd.ZstdCompressor(compression_params=params, dict_data=shared))
    return out


class Classifier:
    def __init__(self, model: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in model]
        self.quick = _compressors(model, LEVEL)
        self.fine = _compressors(model, FINE_LEVEL, min_match=3)

    def sizes(self, compressors: list, text: bytes) -> list[int]:
        pieces = [text[at : at + PIECE] for at in range(0, len(text), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in compressors]

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        if not text or not self.langs:
            return UNKNOWN, 0.0, False
        sizes = self.sizes(self.quick, text)
        best, second = (sorted(sizes) + [math.inf])[:2]
        if second - best <= max(2, FINE_BELOW * len(text)):
            sizes = self.sizes(self.fine, text)
            best, second = (sorted(sizes) + [math.inf])[:2]
        score = 1 / sum(math.exp(best - s) for s in sizes)
        return self.langs[sizes.index(best)], score, second - best > NARROW * best


def predictor(spark: SparkSession, model: list[tuple[str, bytes]]):
    """UDF of letters(text): struct of lang, score, accepted."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Classifier(shared.value)
        for texts in batches:
            found = [known.predict(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=["lang", "score", "accepted"],
            )

    return predict


def annotate(docs: DataFrame, model: list[tuple[str, bytes]], text_col: str = "text", out_col: str = "predicted") -> DataFrame:
    """docs with a struct of lang, score and accepted."""
    predict = predictor(docs.sparkSession, model)
    return docs.withColumn(out_col, predict(letters(F.col(text_col)).cast("binary")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.filter(~held))
    found = annotate(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col("predicted.lang").alias("lang_pred"), F.col("predicted.score").alias("score"), F.col("predicted.accepted").alias("accepted"))
