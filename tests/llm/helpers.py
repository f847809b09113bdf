"""Shared by the tests of the training-data operators."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
DOCS = "doc_id bigint, text string, score double, ids string, component_id bigint"


def docs(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1.0, "x", 7) for r in rows], DOCS)


#: Names that operators might use for columns of their own.
CLASHING = ["y", "_id", "_hit", "_bad", "bad", "_n", "_kept", "n", "fp", "key", "name", "item", "t", "node", "_0", "c0", "c1", "_text", "_pack", "component", "seed", "kept", "worst"]


def clashing(spark, rows):
    """Documents with columns of those names."""
    kinds = ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], f"doc_id bigint, text string, {kinds}")
