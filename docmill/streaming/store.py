"""A keyed table in files: the latest value of each key, changed batch by batch.

Keys are dealt to `parts` by their hash. A batch is merged with the parts that it touches and with no others; those are
written to a new folder, and a manifest then names, for each part, the folder that holds it. So readers see
the table before or after a batch. A batch that was merged already (an epoch that the manifest has) changes nothing,
a run that fails changes nothing, and data that the manifest names but that are gone are an error, not an empty table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docmill.sources import manifest

PARTS = 64


def _parts(spark: SparkSession, root: str, schema, held: dict[str, str], wanted: list[int] | None = None) -> DataFrame | None:
    paths = [f"{root}/{folder}/_part={p}" for p, folder in held.items() if wanted is None or int(p) in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def merge(batch: DataFrame, root: str, key: list[str], order: str, epoch: int | None = None, parts: int = PARTS) -> bool:
    """Merge a batch into the table at root; whether it was new. Of a key's rows the one of the greatest (order, row) stays.

    Rows with a null order are older than all others; nulls are a key like any other.
    """
    spark = batch.sparkSession
    version, held = manifest.current(spark, root)
    if epoch is not None and held.get("epoch") is not None and epoch <= held["epoch"]:
        return False
    parts = held.get("parts", parts)
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    value = F.struct(*batch.columns)
    latest = lambda df: df.groupBy("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(value, F.struct(F.col(order).isNotNull(), order, value)).alias("_r"))
    placed = batch.withColumn("_part", part)
    touched = [r._part for r in placed.select("_part").distinct().collect()]
    before = _parts(spark, root, batch.schema, held.get("at", {}), touched)
    both = placed if before is None else before.withColumn("_part", part).unionByName(placed)
    folder = f"v{version + 1}-{uuid.uuid4().hex[:8]}"
    if touched:
        latest(both).select("_part", "_r.*").write.partitionBy("_part").parquet(f"{root}/{folder}")
    at = held.get("at", {}) | {str(p): folder for p in touched}
    manifest.publish(spark, root, version + 1, {"parts": parts, "epoch": epoch if epoch is not None else held.get("epoch"), "at": at, "folders": sorted(set(at.values())), "schema": batch.schema.json()})
    return True


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table as the newest manifest has it."""
    _, held = manifest.current(spark, root)
    if not held:
        raise FileNotFoundError(f"no manifest in {root}")
    schema = StructType.fromJson(json.loads(held["schema"]))
    found = _parts(spark, root, schema, held["at"])
    return spark.createDataFrame([], schema) if found is None else found


def upsert_stream(stream: DataFrame, key: list[str], order: str, root: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Keep the table at root up to date with a stream; a repeated micro-batch changes nothing."""

    def one(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            merge(held, root, key, order, epoch, parts)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
