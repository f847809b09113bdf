import os
import uuid

import pytest
from pyspark.sql import functions as F

from docmill.sources import index, manifest
from docmill.streaming import store


def write(folder, name, text, at=None):
    path = folder / name
    path.parent.mkdir(exist_ok=True)
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


def make(files):
    return index.chunks_of(files, lambda text: F.when(text.contains("claim"), "claim").otherwise("other"))


def held(spark, root):
    return sorted((r.path.rsplit("/", 1)[1], r.clean_text, r.doc_type) for r in index.rows(spark, root).collect())


def test_a_second_run_reads_what_changed_only(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", str(tmp_path / "index")
    for name, text in (("a.txt", "a claim\n\nmore"), ("b.txt", "plain"), ("c.txt", "gone soon")):
        write(folder, name, text, 1_700_000_000)
    assert index.refresh(spark, str(folder), root, make) == {"new": 3, "changed": 0, "deleted": 0, "same": 0}
    assert held(spark, root) == [("a.txt", "a claim", "claim"), ("a.txt", "more", "claim"), ("b.txt", "plain", "other"), ("c.txt", "gone soon", "other")]
    read = []
    monkeypatch.setattr(index, "changed_files", lambda s, paths, f=index.changed_files: read.extend(f(s, paths).inputFiles()) or f(s, paths))
    assert index.refresh(spark, str(folder), root, make) == {"new": 0, "changed": 0, "deleted": 0, "same": 3}
    assert read == [] and manifest.versions(spark, root) == [1]
    write(folder, "b.txt", "a new claim", 1_700_000_100)
    write(folder, "d.txt", "fresh")
    (folder / "c.txt").unlink()
    assert index.refresh(spark, str(folder), root, make) == {"new": 1, "changed": 1, "deleted": 1, "same": 1}
    assert sorted(x.rsplit("/", 1)[1] for x in read) == ["b.txt", "d.txt"]
    want = [("a.txt", "a claim", "claim"), ("a.txt", "more", "claim"), ("b.txt", "a new claim", "claim"), ("d.txt", "fresh", "other")]
    assert held(spark, root) == want
    index.compact(spark, root)
    assert held(spark, root) == want and sorted(os.listdir(root))[0] == manifest.FOLDER
    assert index.refresh(spark, str(folder), root, make, force=True)["changed"] == 3 and held(spark, root) == want


def test_a_failed_run_leaves_the_index_as_it_was(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "index")
    write(folder, "a.txt", "one")
    index.refresh(spark, str(folder), root, make)
    write(folder, "b.txt", "two")

    def broken(files):
        return make(files).withColumn("clean_text", F.raise_error(F.lit("no")))

    with pytest.raises(Exception, match="no"):
        index.refresh(spark, str(folder), root, broken)
    assert held(spark, root) == [("a.txt", "one", "other")]
    index.refresh(spark, str(folder), root, make)
    assert len(held(spark, root)) == 2
    with pytest.raises(RuntimeError):
        manifest.publish(spark, root, 2, {"folders": []})
    with pytest.raises(FileNotFoundError):
        index.rows(spark, str(tmp_path / "none"))


def test_chunk_tables_join_without_a_shuffle_and_prune_by_case(spark, tmp_path):
    rows = [(f"case{i % 7}", i, f"chunk {j} of {i}") for i in range(60) for j in range(3)]
    chunks = spark.createDataFrame(rows, "case_id string, doc_id long, clean_text string")
    docs = spark.createDataFrame([(f"case{i % 7}", i, f"title {i}") for i in range(60)], "case_id string, doc_id long, title string")
    names = [f"t{uuid.uuid4().hex}" for _ in range(2)]
    try:
        a = index.write_chunks(chunks, names[0], str(tmp_path / "a"), "case_id", "doc_id", 4, 8)
        b = index.write_chunks(docs, names[1], str(tmp_path / "b"), "case_id", "doc_id", 4, 8)
        met = a.hint("merge").join(b.select("doc_id", "title"), "doc_id")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and met.count() == 180
        one = index.of_case(a, "case_id", "case3", 4)
        assert sorted(r.clean_text for r in one.collect()) == sorted(t for c, _, t in rows if c == "case3")
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(case_part" in plan and len(one.inputFiles()) < len(a.inputFiles())
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


SCHEMA = "k string, at long, v string"


def stored(spark, root):
    return sorted((r.k or "", r.v) for r in store.read(spark, root).collect())


def test_the_store_keeps_the_latest_and_touches_few_parts(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.createDataFrame([(f"k{i}", 1, f"a{i}") for i in range(100)] + [(None, 1, "none")], SCHEMA)
    assert store.merge(first, root, ["k"], "at", 0, 8)
    before = manifest.current(spark, root)[1]["at"]
    more = spark.createDataFrame([("k5", 3, "new"), ("k5", 2, "older"), ("k5", None, "oldest"), ("k7", 0, "too old")], SCHEMA)
    assert store.merge(more, root, ["k"], "at", 1)
    want = sorted([(f"k{i}", f"a{i}" if i != 5 else "new") for i in range(100)] + [("", "none")])
    assert stored(spark, root) == want
    after = manifest.current(spark, root)[1]["at"]
    assert 1 <= sum(after[p] != before[p] for p in before) <= 2 and len(after) == 8
    assert not store.merge(spark.createDataFrame([("k5", 9, "replayed")], SCHEMA), root, ["k"], "at", 1)
    assert stored(spark, root) == want
    assert store.merge(more.limit(0), root, ["k"], "at", 2) and stored(spark, root) == want
    manifest.tidy(spark, root, 1)
    assert stored(spark, root) == want


def test_a_lost_version_is_an_error(spark, tmp_path):
    import shutil

    root = str(tmp_path / "t")
    store.merge(spark.createDataFrame([("a", 1, "x")], SCHEMA), root, ["k"], "at", 0, 2)
    folder = manifest.current(spark, root)[1]["folders"][0]
    shutil.rmtree(f"{root}/{folder}")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.merge(spark.createDataFrame([("a", 2, "y")], SCHEMA), root, ["k"], "at", 1)
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "never"))
