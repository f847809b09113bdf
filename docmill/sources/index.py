"""From files to searchable chunks, and again after some of the files have changed.

An index is a folder with a manifest (docmill.sources.manifest). It has a table of files (path, fingerprint, the folder
that has what was made of it) and, for each run, a folder of what was made of the files that were new or
changed then. A run lists the files, compares fingerprints (mtime:size), reads those that differ and no others, and
names the new state last. Rows of files that changed or went stay in old folders until `compact`, but are not read as live ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import chunking
from docmill.sources import files as S
from docmill.sources import manifest

NEW, CHANGED, DELETED, SAME = "new", "changed", "deleted", "same"


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path, fingerprint of the files in a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    return found.select("path", S.fingerprint(F.col("modificationTime"), F.col("length")).alias("fingerprint"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change (new, changed, deleted, same) between two listings (path, fingerprint)."""
    met = before.select("path", F.col("fingerprint").alias("_b"), F.lit(True).alias("_was")).join(now.select("path", F.col("fingerprint").alias("_n"), F.lit(True).alias("_is")), "path", "full")
    change = F.when(F.col("_was").isNull(), NEW).when(F.col("_is").isNull(), DELETED).when(F.col("_b").eqNullSafe(F.col("_n")), SAME).otherwise(CHANGED)
    return met.select("path", change.alias("change"))


def _files(spark: SparkSession, root: str, held: dict) -> DataFrame:
    if not held:
        return spark.createDataFrame([], "path string, fingerprint string, made string")
    return spark.read.schema("path string, fingerprint string, made string").parquet(f"{root}/{held['files']}")


def _made(spark: SparkSession, root: str, held: dict) -> DataFrame:
    """Live rows: what was made of a file in the run that the file table names."""
    folders = [f"{root}/{d}" for d in held["made"]]
    every = spark.read.option("basePath", root).parquet(*folders).withColumn("_made", F.regexp_extract(F.input_file_name(), r"/(made-[0-9a-f-]+)/", 1))
    live = _files(spark, root, held).select(F.col("path").alias("_path"), F.col("made").alias("_of"))
    return every.join(live, (F.col("path") == F.col("_path")) & (F.col("_made") == F.col("_of")), "left_semi").drop("_made")


def changed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of those paths (as listings have them), with their contents."""
    read = spark.read.format("binaryFile").load(paths)
    return read.select("path", F.col("modificationTime").alias("modified"), "length", "content", S.file_type(F.col("content"), F.col("path")).alias("file_type"))


def refresh(spark: SparkSession, folder: str, root: str, make: Callable[[DataFrame], DataFrame], glob: str | None = None, force: bool = False) -> dict[str, int]:
    """Bring the index at root up to date with a folder; how many files were new, changed, deleted, same.

    make maps files (path, modified, length, content, file_type) to rows that have the path. With force all files are made
    anew. The driver sees the paths of files that differ, which is less than it lists for any reader.
    """
    version, held = manifest.current(spark, root)
    now, before = listing(spark, folder, glob), _files(spark, root, held)
    told = {r.path: r.change for r in changes(before, now).filter(F.lit(force) | (F.col("change") != SAME)).collect()}
    if force:
        told = {p: CHANGED if c == SAME else c for p, c in told.items()}
    todo = sorted(p for p, c in told.items() if c in (NEW, CHANGED))
    counts = {c: sum(x == c for x in told.values()) for c in (NEW, CHANGED, DELETED)}
    counts[SAME] = now.count() - len(todo)
    if not told and held:
        return counts
    run = uuid.uuid4().hex[:8]
    made = f"made-{version + 1}-{run}"
    if todo:
        make(changed_files(spark, todo)).write.parquet(f"{root}/{made}")
    differs = spark.createDataFrame([(p,) for p in told], "path string")
    table = before.join(differs, "path", "left_anti").unionByName(now.join(differs, "path", "left_semi").withColumn("made", F.lit(made)))
    files = f"files-{version + 1}-{run}"
    table.write.parquet(f"{root}/{files}")
    folders = held.get("made", []) + ([made] if todo else [])
    manifest.publish(spark, root, version + 1, {"files": files, "made": folders, "folders": [files, *folders]})
    return counts


def rows(spark: SparkSession, root: str) -> DataFrame:
    """What the index holds of the files that are there now."""
    _, held = manifest.current(spark, root)
    if not held or not held["made"]:
        raise FileNotFoundError(f"nothing is indexed in {root}")
    return _made(spark, root, held)


def compact(spark: SparkSession, root: str) -> None:
    """Write the live rows to one folder, and drop all others but the last state's."""
    version, held = manifest.current(spark, root)
    run = uuid.uuid4().hex[:8]
    made, files = f"made-{version + 1}-{run}", f"files-{version + 1}-{run}"
    _made(spark, root, held).write.parquet(f"{root}/{made}")
    _files(spark, root, held).withColumn("made", F.lit(made)).write.parquet(f"{root}/{files}")
    manifest.publish(spark, root, version + 1, {"files": files, "made": [made], "folders": [files, made]})
    manifest.tidy(spark, root)


def chunks_of(files: DataFrame, classify: Callable, most: int = 2000) -> DataFrame:
    """path, chunk_id, page_number, paragraph_number, clean_text, doc_type, file_type of text files; others have none."""
    texts = S.extract(files).filter("error is null")
    kinds = texts.select(F.col("path").alias("_path"), classify(F.col("text")).alias("doc_type"), "file_type")
    pieces = chunking.segments(texts, "path", "text", most)
    return pieces.join(kinds, F.col("path") == F.col("_path")).drop("_path")


# -- chunks as a table that joins and filters without a shuffle ------------------------------------


def write_chunks(chunks: DataFrame, name: str, where: str, case: str, doc: str, cases: int = 16, buckets: int = 16) -> DataFrame:
    """chunks as table `name` at `where`: in folders by the case's hash, and in each bucketed and sorted by doc.

    Joins of two such tables by doc need no shuffle, and of_case() reads one folder. Buckets are dealt before
    writing, so a folder has one file for each bucket.
    """
    spark = chunks.sparkSession
    placed = chunks.withColumn("case_part", F.pmod(F.hash(case), F.lit(cases))).repartition(buckets, doc)
    writer = placed.write.partitionBy("case_part").bucketBy(buckets, doc).sortBy(doc)
    writer.option("path", where).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def of_case(chunks: DataFrame, case: str, value, cases: int = 16) -> DataFrame:
    """The chunks of one case: its folder alone is listed and read."""
    part = chunks.sparkSession.range(1).select(F.pmod(F.hash(F.lit(value).cast(chunks.schema[case].dataType)), F.lit(cases))).first()[0]
    return chunks.filter((F.col("case_part") == part) & (F.col(case) == value))
