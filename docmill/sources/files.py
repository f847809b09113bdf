"""File sources: type sniffing, decoding, ingestion, sinks. Paths are any that Spark reads."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docmill.functions.text import basename, object_key
from docmill.workers import ship

# How files of each type begin, and the endings of the others.
MAGIC = (
    ("25504446", "pdf"),  # %PDF
    ("89504E47", "image"),  # PNG
    ("FFD8FF", "image"),  # JPEG
    ("47494638", "image"),  # GIF8
    ("424D", "image"),  # BM
    ("52494646", "image"),  # RIFF
    ("49492A00", "image"),  # TIFF, little end first
    ("4D4D002A", "image"),  # TIFF, big end first
)
ENDINGS = {"text": ("txt", "text", "md"), "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp")}
ENCODINGS = ("utf-8", "cp1256", "cp1252")


def file_type(content: Column, path: Column) -> Column:
    """text, pdf, image or unknown: by the first bytes, else by the ending."""
    head = F.hex(F.substring(content, 1, 8))
    by_bytes = [F.when(head.startswith(m), t) for m, t in MAGIC]
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*by_bytes, *[F.when(ending.isin(*es), t) for t, es in ENDINGS.items()], F.lit("unknown"))


@cache
def _decoder():
    def one(raw: bytes) -> str:
        for encoding in ENCODINGS:
            try:
                return bytes(raw).decode(encoding)
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("utf-8", "replace")

    @pandas_udf("string")
    def convert(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: None if x is None else one(x))

    return convert


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, else the Arabic and Latin code pages in turn, else UTF-8 with replacements."""
    text = content.cast("string")
    return F.coalesce(_decoder()(F.when(~F.is_valid_utf8(text), content)), text)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modified, length, content, file_type."""
    ship(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", "content", file_type(F.col("content"), F.col("path")).alias("file_type"))


def extract(files: DataFrame, pdf=None, image=None) -> DataFrame:
    """path, file_type, text, error. Text files (and unknown ones) are decoded; pdf and image are functions
    DataFrame -> DataFrame(path, text) for theirs, without which such files give an error row."""
    plain = files.filter(F.col("file_type").isin("text", "unknown")).select("path", "file_type", decoded(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    out = plain
    for kind, port in (("pdf", pdf), ("image", image)):
        these = files.filter(F.col("file_type") == kind)
        if port is None:
            rows = these.select("path", "file_type", F.lit("").alias("text"), F.lit(f"no reader for {kind}").alias("error"))
        else:
            rows = these.select("path", "file_type").join(port(these), "path", "left").select("path", "file_type", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("error"))
        out = out.unionByName(rows)
    return out


def ingest(extracted: DataFrame, case_id: str, classify: Column, confidence: Column) -> DataFrame:
    """Document records of extracted files; those without text are unknown with confidence 0."""
    said = F.trim(F.coalesce("text", F.lit(""))) != ""
    record = F.md5(F.concat_ws("|", F.lit(case_id), "path"))
    return extracted.select(
        record.alias("record_id"),
        F.when(said, classify).otherwise("unknown").alias("doc_type"),
        F.when(said, confidence).otherwise(0).alias("classification_confidence"),
        F.lit(case_id).alias("case_id"),
        F.replace("path", F.lit("\\"), F.lit("/")).alias("source_file"),
        basename(F.col("path")).alias("filename"),
        object_key(F.lit(case_id), record, F.col("path")).alias("object_key"),
        F.coalesce("text", F.lit("")).alias("text"),
        "file_type",
        "error",
    )


def write_once(df: DataFrame, path: str, force: bool = False, **layout) -> None:
    """Write a table unless it is there; force writes it anew. layout: partition_by."""
    writer = df.write.mode("overwrite" if force else "ignore")
    if layout.get("partition_by"):
        writer = writer.partitionBy(*layout["partition_by"])
    writer.parquet(path)


def fingerprint(modified: Column, size: Column) -> Column:
    """mtime:size, under which what was made of a file is kept."""
    return F.concat_ws(":", F.unix_millis(modified).cast("string"), size.cast("string"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))


def append_audit(df: DataFrame, path: str, day: str) -> None:
    """Append audit rows under the day of a timestamp."""
    df.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def in_order(rows: DataFrame, paths: list[str]) -> DataFrame:
    """rows of files with pos, the place of their path in the list that was asked for; a path asked for that has no row has one with an error."""
    plain = lambda p: F.regexp_replace(p, "^file:/+", "/")
    asked = rows.sparkSession.createDataFrame(list(enumerate(paths)), "pos int, _asked string")
    met = asked.join(rows, plain(F.col("_asked")) == plain(F.col("path")), "left")
    return met.select("pos", *[F.coalesce("path", "_asked").alias(c) if c == "path" else F.coalesce(c, F.when(F.col("path").isNull(), "no such file")).alias(c) if c == "error" else c for c in rows.columns])


def point_count(spark: SparkSession, name: str) -> int:
    """How many rows a table has; 0 for one that is not there."""
    return spark.table(name).count() if spark.catalog.tableExists(name) else 0


def golden(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a golden dataset: a JSON array in one file, or one object a line."""
    return spark.read.option("multiLine", "true").json(path)
