"""The query catalogue: name -> query, name -> DuckDB oracle."""

from __future__ import annotations

from docmill.plans import cases, citing, flows, matching, reasoning, relational, reports, retrieval, stateful, summaries, texts  # noqa: F401  each registers its queries
from docmill.plans.registry import ORACLE_SQL, QUERIES

flagship = retrieval.dedupe_confidence_grade

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
