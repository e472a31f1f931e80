"""Line deduplication by distinct-site spread, in DataFrame functions only.

Lines that stand on many different sites are boilerplate. A HyperLogLog sketch of
sites is kept for each line's hash and merged by aggregation, so a line that is
everywhere costs one sketch for each task. Lines whose estimate is near the
threshold get an exact distinct count before the decision. Lines that stand on
MIN_SITES sites or more are removed from every document; the rest keep their
order.

Defined cases: null text counts as empty and stays empty; blank lines are never
boilerplate; lines are compared after trimming; a null site is a site of its own
that counts as none; repeated rows each keep their row; a document whose lines
are all boilerplate becomes empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

MIN_SITES = 10
NEAR = 0.2  # relative band around the threshold in which estimates are not trusted
SALTS = 32  # parts into which the documents of one line are dealt
LG_K = 12  # 4096 registers: relative error 1.6 %


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a trimmed line; null for a blank one."""
    plain = F.trim(line)
    return F.when(plain != "", F.md5(plain.cast("binary")))


def spread_lines(docs: DataFrame, site_col: str, text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """key: the hashes of lines that stand on min_sites sites or more."""
    keys = F.array_distinct(F.transform(_lines(F.col(text_col)), _key))
    seen = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(keys).alias("key")).filter("key IS NOT NULL")
    sketched = seen.groupBy("key").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("site").alias("low"), F.max("site").alias("high"))
    several = F.col("low") < F.col("high") if min_sites > 1 else F.col("low").isNotNull()
    guess = sketched.filter(several).select("key", F.hll_sketch_estimate("sketch").alias("sites"))
    guess = cut(guess.filter(F.col("sites") >= min_sites * (1 - NEAR)))
    sure = guess.filter(F.col("sites") > min_sites * (1 + NEAR)).select("key")
    near = guess.filter(F.col("sites") <= min_sites * (1 + NEAR)).select("key")
    exact = seen.distinct().join(near, "key", "left_semi").groupBy("key").agg(F.count("site").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("key"))


def remove_spread_lines(docs: DataFrame, site_col: str, id_col: str = "doc_id", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, text without cross-site lines, n_lines, n_removed for each row of docs."""
    spread = cut(spread_lines(docs, site_col, text_col, min_sites))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = rows.select("doc_id", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias("key")).filter("key IS NOT NULL")
    keys = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = spread.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    marked = keys.join(salted, ["key", "salt"], "left_semi").select("doc_id", "key").distinct().groupBy("doc_id").agg(F.collect_list("key").alias("gone"))
    joined = rows.join(marked.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    whole = _lines(F.col("text"))
    kept = F.filter(whole, lambda line: ~F.coalesce(F.array_contains(F.col("gone"), _key(line)), F.lit(False)))
    kept = F.when(F.col("gone").isNull(), whole).otherwise(kept)
    return joined.select("doc_id", F.array_join(kept, "\n").alias("text"), F.size(whole).cast("long").alias("n_lines"), (F.size(whole) - F.size(kept)).cast("long").alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_spread_lines(table(spark, sf_dir, "documents"), "source")


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents),
k AS (SELECT doc_id, source, line, place, trim(line, ' ') AS key FROM l),
s AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE s.key IS NULL), '') AS text,
       count(*) AS n_lines, count(s.key) AS n_removed
FROM k LEFT JOIN s ON k.key = s.key GROUP BY doc_id
"""
