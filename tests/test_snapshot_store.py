from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from buildlens.operators import deltas
from buildlens.sources.scan import artifacts
from buildlens.sources.snapshot_store import SnapshotStore

FILE = "run_id string, path string, line_pct double"
RUN = "run_id string, version int, label string, total long, passed long, failed long, skipped long, line_pct double, has_tests boolean, has_coverage boolean"


@pytest.fixture
def store(spark, tmp_path):
    made = SnapshotStore(spark, f"snaps_{tmp_path.name}", str(tmp_path / "store"), buckets=4).open()
    yield made
    for part in ("runs", "files"):
        spark.sql(f"DROP TABLE IF EXISTS {made.name}_{part}")


def run_rows(spark, *runs, version=1):
    return spark.createDataFrame([(r, version, r.upper(), n, n - 1, 1, 0, pct, True, True) for r, n, pct in runs], RUN)


def file_rows(spark, runs):
    return spark.createDataFrame([(r, p, v) for r, files in runs.items() for p, v in files.items()], FILE)


def test_two_runs_without_a_shuffle(spark, store):
    paths = {f"src/f{i}.go": float(i % 100) for i in range(2000)}
    changed = {p: v + (1.0 if i % 10 == 0 else 0.0) for i, (p, v) in enumerate(paths.items()) if i % 7} | {"new.go": 1.0}
    store.save(run_rows(spark, ("a", 5, 50.0), ("b", 7, 51.5)), file_rows(spark, {"a": paths, "b": changed}))
    got = store.file_deltas("a", "b")
    assert rows(got, "path", "delta") == sorted((p, 1.0) for p in changed if p in paths and changed[p] != paths[p])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "PartitionFilters: [isnotnull(batch_day" in plan
    delta = store.run_delta("a", "b").first()
    assert (delta["total_delta"], delta["passed_delta"], delta["failed_delta"], delta["line_pct_delta"]) == (2, 2, 0, 1.5)


def test_a_run_saved_again_is_replaced(spark, store):
    store.save(run_rows(spark, ("a", 1, 10.0), ("b", 1, 10.0)), file_rows(spark, {"a": {"x": 1.0, "gone": 2.0}, "b": {"x": 5.0}}), batch=1)
    store.save(run_rows(spark, ("a", 2, 20.0)), file_rows(spark, {"a": {"x": 3.0}}), batch=2 * 10**18)
    assert rows(store.files("a"), "path", "line_pct") == [("x", 3.0)]
    assert rows(store.runs(), "run_id", "total") == [("a", 2), ("b", 1)]
    assert rows(store.file_deltas("a", "b"), "path", "delta") == [("x", 2.0)]
    with pytest.raises(LookupError):
        store.files("c")


def test_versions_and_runs_without_files(spark, store):
    store.save(run_rows(spark, ("new", 1, 1.0), version=2))
    with pytest.raises(ValueError, match="version 2"):
        store.files("new")
    store.save(run_rows(spark, ("bare", 1, 1.0)))
    assert store.files("bare").count() == 0 and store.run("bare").count() == 1


def test_opened_again_and_through_json(spark, store, tmp_path):
    store.save(run_rows(spark, ("a", 3, 50.0)), file_rows(spark, {"a": {"x": 0.1, 'q"\\': 2.0}}))
    for part in ("runs", "files"):
        spark.sql(f"DROP TABLE {store.name}_{part}")
    again = SnapshotStore(spark, store.name, store.location, buckets=4).open()
    assert rows(again.files("a"), "path", "line_pct") == [('q"\\', 2.0), ("x", 0.1)]

    again.export_json(str(tmp_path / "json"))
    other = SnapshotStore(spark, store.name + "_copy", str(tmp_path / "copy"), buckets=4).open()
    other.import_json(artifacts(str(tmp_path / "json"), run_id=F.regexp_extract("source", r"run_id=([^/]+)", 1)))
    assert rows(other.files("a"), "path", "line_pct") == rows(again.files("a"), "path", "line_pct")
    columns = ("run_id", "label", *deltas.COUNTS, "line_pct", "has_tests", "has_coverage")
    assert rows(other.runs(), *columns) == rows(again.runs(), *columns)
    for part in ("runs", "files"):
        spark.sql(f"DROP TABLE {other.name}_{part}")
