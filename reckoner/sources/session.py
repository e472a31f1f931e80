"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


#: Types that Parquet cannot hold.
NOT_STORED = ("void", "interval", "variant")


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind Parquet files in the shared folder, so that what follows reads only the columns it needs.

    Rows that Parquet cannot hold are kept as a reliable checkpoint.
    """
    spark, held = df.sparkSession, df.schema.simpleString()
    shared_dir(spark)
    if not df.columns or len({c.lower() for c in df.columns}) < len(df.columns) or any(t in held for t in NOT_STORED):
        return df.checkpoint()
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """The same rows, which the next join sorts and merges and never gathers on the driver.

    For what grows with the input. Spark tells a table's size by its compressed files and takes
    an exploded row for one, so that it broadcasts tables many times as large as its limit.
    """
    return df.hint("merge")


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table's files are still the same: their path, lengths and times."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    own = fs.getFileStatus(where)
    found = [own, *fs.listStatus(where)] if own.isDirectory() else [own]
    return path, sum(f.getLen() for f in found), max(f.getModificationTime() for f in found), len(found)
