"""Table access shared by every query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task takes of a table which is grouped by a key.
ROWS_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark's readers accept."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: DataFrame) -> int:
    """How many tasks take a table's rows at ROWS_A_TASK each, or the session's number of shuffle partitions if that is more.

    Rows of a Parquet table are counted from its footers. A fixed number of tasks would need the more memory each the more rows there are.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_TASK))


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df dealt by its keys to n tasks; as it is where no number is given."""
    return df if n is None else df.repartition(n, *keys)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset on one machine."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docmill-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def settled(df: DataFrame) -> DataFrame:
    """df computed once: written to the folder that executors share (spark.checkpoint.dir), where one is set.

    Loops use it, so that a step's result is not computed again by each step after it.
    """
    path = f"{shared(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
