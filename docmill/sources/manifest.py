"""Which files make up a table just now: numbered manifests, of which the newest counts.

A manifest is one small JSON file, written beside its place and then renamed to it, so that readers see a whole one or
none, on any file system of Spark's. Data that no manifest names are nobody's: a run that fails leaves the
table as it was, and `tidy` removes what it wrote.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_manifests"


def _place(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _place(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/{FOLDER}") if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The newest manifest's number and content; 0 and {} where there is none."""
    known = versions(spark, root)
    if not known:
        return 0, {}
    files, at = _place(spark, f"{root}/{FOLDER}/{known[-1]}.json")
    stream = files.open(at)
    try:
        return known[-1], json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Name `content` current. A version that somebody else has published meanwhile is an error, and stays."""
    files, at = _place(spark, f"{root}/{FOLDER}/{version}.json")
    _, beside = _place(spark, f"{root}/{FOLDER}/.{version}-{uuid.uuid4().hex}")
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if files.exists(at) or not files.rename(beside, at):
        files.delete(beside, False)
        raise RuntimeError(f"version {version} of {root} is there already")


def tidy(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all but the newest manifests, and the folders that those don't name (content["folders"])."""
    known = versions(spark, root)
    named = set()
    for v in known[-keep:]:
        files, at = _place(spark, f"{root}/{FOLDER}/{v}.json")
        stream = files.open(at)
        named |= set(json.loads(bytes(stream.readAllBytes()).decode())["folders"])
        stream.close()
    for v in known[:-keep]:
        files, at = _place(spark, f"{root}/{FOLDER}/{v}.json")
        files.delete(at, False)
    for name in _names(spark, root):
        if name != FOLDER and name not in named:
            files, at = _place(spark, f"{root}/{name}")
            files.delete(at, True)
