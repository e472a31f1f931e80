"""The training-data pipeline: five stages over documents, each written and read again.

language ID: documents whose language is rejected go.
exact dedup: of equal texts the one with the smallest doc_id stays.
near dedup: of each component the one with the smallest doc_id stays; links are
SimHash links and a Jaccard similarity of 0.8 or more on five-word shingles.
mixing: a document comes as often as its fitted rate says.
BPE: each document's ids and their decoding, as digests.

Defined cases, for every stage: no rows give no rows; other columns stay, whatever
their names, but for the last stage, which returns digests. Null, empty or
letterless text has no language and goes; in exact dedup null counts as empty. Rows
are told apart by their place in the table, so null and repeated ids keep the
meaning of rows: of equal or linked texts just one row stays, the first of the
smallest id, nulls last. Mixing draws by the id, so rows of one id come equally
often.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reckoner.llm import bpe, exact, langid, mixing, simhash
from reckoner.llm.common import ROW, keyed, shared_dir, table

NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.annotate(docs, langid.fit(docs), out_col="__language")
    return found.filter("__language.accepted").select(*docs.columns)


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs, which have their places, that found keeps."""
    return docs.join(found.filter("kept").select(*ROW), ROW, "left_semi").drop(*ROW)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs)
    return _kept(docs, exact.groups_of(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs)
    return _kept(docs, simhash.components_of(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def bpe_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixed),
    ("byte_level_bpe", bpe_codes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


#: The stages hold trained models and graph components, which SQL cannot express; tests/llm compare the operators with brute force.
ORACLE_SQL = None
