"""Steps whose tasks must not grow with the tables: numbers of tasks follow from rows, candidates from what is shared."""

import re
from pathlib import Path

import pytest

from docmill import tables
from docmill.operators import citations, graphs, reasoning
from docmill.plans import catalogue

SF = "/root/testdata/sf0.001"
tables_here = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def task_counts(spark, monkeypatch, name):
    """The numbers of tasks that a query's rows are dealt to, where a task takes 100 of some 6,000 lines."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100, raising=False)
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan)}


@tables_here
def test_verified_counts_take_more_tasks_for_more_rows(spark, monkeypatch):
    assert min(task_counts(spark, monkeypatch, "citation_verified_counts")) >= 50
    cited = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (2, 5), (3, None), (None, 5)], "k int, n int")
    known = spark.createDataFrame([(1, 7), (2, 9), (4, 1), (3, None), (None, 5)], "k int, n int")
    got = {r.k: (r.total, r.verified, r.missing) for r in citations.verified_counts(cited, known, "k", "n", n_tasks=3).collect()}
    assert got == {1: (2, 1, [5]), 2: (1, 0, [5]), 3: (1, 0, []), None: (1, 0, [5])}


@tables_here
def test_completeness_takes_more_tasks_for_more_rows(spark, monkeypatch):
    assert min(task_counts(spark, monkeypatch, "completeness_ratio")) >= 50
    asked = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (2, 5), (3, None), (None, 5)], "k int, n int")
    known = spark.createDataFrame([(1, 7), (2, 9), (4, 1), (3, None), (None, 5)], "k int, n int")
    got = {r.k: (r.n_required, r.n_covered, r.ratio) for r in reasoning.completeness(asked, known, "k", "n", n_tasks=3).collect()}
    assert got == {1: (2, 1, 0.5), 2: (1, 0, 0.0), 3: (1, 0, 0.0), None: (1, 0, 0.0)}


@tables_here
def test_scores_take_more_tasks_for_more_rows(spark, monkeypatch):
    assert max(task_counts(spark, monkeypatch, "case_score")) >= 50 and min(task_counts(spark, monkeypatch, "weighted_confidence")) >= 50


@tables_here
def test_ready_steps_take_more_tasks_for_more_rows(spark, monkeypatch):
    assert min(task_counts(spark, monkeypatch, "ready_steps")) >= 50
    steps = spark.createDataFrame([("a", None), ("b", []), ("c", ["a"]), ("d", ["a", "b"]), ("e", ["x"]), ("f", ["a", "a"]), ("g", [None, "b"])], "step_id string, depends_on array<string>")
    done, capped = spark.createDataFrame([("a",), ("a",), ("z",)], "step_id string"), spark.createDataFrame([("f",)], "step_id string")
    for n in (None, 3):
        assert sorted(r.step_id for r in reasoning.ready(steps, done, capped, n_tasks=n).collect()) == ["b", "c"]


@tables_here
def test_issues_meet_only_where_they_share_enough(spark, monkeypatch):
    """300 issues that all have one entity in common, and two pairs that have more."""
    assert max(task_counts(spark, monkeypatch, "shared_entity_pairs")) >= 50
    rows = [(i, e) for i in range(300) for e in (0, 1000 + i // 2 if i < 4 else 2000 + i, None)] + [(0, 7), (1, 7), (0, 7), (None, 0)]
    df = spark.createDataFrame(rows, "i int, e int")
    assert reasoning.meetings(df, "i", "e").count() == 4
    for n in (None, 3):
        got = sorted((r.issue_a, r.issue_b, r.n_shared, r.shared) for r in reasoning.shared_entity_pairs(df, "i", "e", n_tasks=n).collect())
        assert got == [(0, 1, 3, [0, 7, 1000]), (2, 3, 2, [0, 1001])]
    assert [(r.issue_a, r.issue_b) for r in reasoning.shared_entity_pairs(df, "i", "e", 3).collect()] == [(0, 1)]
    assert reasoning.shared_entity_pairs(df, "i", "e", 1).count() == 300 * 299 // 2


@tables_here
def test_raw_summaries_take_more_tasks_for_more_rows_and_move_them_once(spark, monkeypatch):
    assert min(task_counts(spark, monkeypatch, "raw_summaries")) >= 50
    plan = catalogue.QUERIES["raw_summaries"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_rounds_of_the_cycle_search_move_edges_that_are_left(spark, monkeypatch):
    """100 steps that need nothing, a chain of 8 and a cycle of 2 that the chain ends in: 9 edges move, then fewer."""
    moved, settled = [], graphs.settled
    monkeypatch.setattr(graphs, "settled", lambda df: moved.append(out := settled(df)) or out)
    rows = [(f"x{i}", []) for i in range(100)] + [(f"c{i}", [f"c{i + 1}", "nowhere"]) for i in range(7)] + [("c7", ["a"]), ("a", ["b", "b"]), ("b", ["a", None])]
    df = spark.createDataFrame(rows, "step_id string, depends_on array<string>")
    assert sorted(r.step_id for r in graphs.looped(df, "step_id", "depends_on").collect()) == ["a", "b"]
    counts = [d.count() for d in moved]
    assert counts[0] <= 18 and counts[-1] == 2 and counts == sorted(counts, reverse=True) and len(counts) <= 12


@tables_here
def test_bullets_are_put_into_themes_once_for_a_brief(spark):
    """What follows the themes groups by role and by case; nothing before them is done again."""
    plan = catalogue.QUERIES["case_briefs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 4
