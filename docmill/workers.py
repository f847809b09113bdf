"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: The one thing that a Python worker keeps from task to task; what another operator needs replaces it.
_KEPT: dict = {}


def keep(key, make):
    """What make() gives, kept in this worker until something else is."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def keep_nothing() -> None:
    """For operators that need the worker's memory themselves."""
    _KEPT.clear()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    where = Path(tempfile.mkdtemp(prefix="docmill-")) / "docmill_sources.zip"
    where.write_bytes(packed.getvalue())
    sc.addPyFile(str(where))
    _SHIPPED.add(sc.applicationId)
