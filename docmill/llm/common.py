"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (tests, one machine) a temporary folder is set once and kept.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docmill-"))
        found = sc.getCheckpointDir()
    return found


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table written in the shared folder, which survives the loss of executors; and where it is.

    Unlike DataFrame.checkpoint() this also forgets what the optimizer derived of df (constraints
    grow with every round of a loop otherwise) and knows its size.
    """
    where = f"{shared_dir(df.sparkSession)}/docmill-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where), where


def checkpoint(df: DataFrame) -> DataFrame:
    """df as such a table."""
    return stored(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, on whatever file system it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def private(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with columns renamed to c0, c1 ... in order, and what the given columns are called then.

    Whatever a caller's columns are named, they clash with nothing that an operator adds; toDF
    with the old names gives them back.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; 0 is the held-out fold."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5
