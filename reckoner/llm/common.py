"""What the operators share: reading a table, cutting lineage, UTF-8 columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What names a row: its file and its place there, whatever its id and however the file is read.
ROW = ["__file", "__row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset on one machine (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a table in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _plain_scan(docs: DataFrame) -> bool:
    """Whether each row of docs is a row of a file: a scan, with columns and rows chosen."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and len(docs.inputFiles()) > 0


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the columns ROW. What isn't read from files as it stands is written first."""
    rows = docs if _plain_scan(docs) else written(docs, "rows")
    return rows.select("*", F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))


def utf8(col: Column) -> Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(m))
