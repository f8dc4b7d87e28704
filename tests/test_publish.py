from __future__ import annotations

import json
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import files

from buildlens.operators import deltas, publish
from buildlens.sources.scan import artifacts
from buildlens.sources.snapshots import flat_snapshots, loaded_files, read_snapshots

STAMP = "2024-05-01T00:00:00Z"
FULL = (
    "run_id string, source_ord string, suite string, name string, seq bigint, status string, duration_ns bigint, "
    "message string, stdout string, file string, line int, attachments array<string>"
)


@pytest.fixture
def cases(spark):
    data = [
        ("r", "1", "pkg.B", "b1", 0, "fail", 1_999_999, "first: 50%\nsecond", "out\nput", "src/b.go", 42, None),
        ("r", "1", "pkg.A", "a1", 1, "pass", 0, None, None, None, None, ["x.png"]),
        ("r", "2", "pkg.B", "b2", 0, "fail", 0, None, None, None, None, None),
        ("r", "2", "pkg.C", 'c"<1>', 1, "skip", 5_000_000, "later", "hidden", "src/c.go", 0, None),
        ("q", "1", "only", "ok", 0, "flaky", 0, None, None, None, None, None),
    ]
    return spark.createDataFrame(data, FULL)


def document(df, run):
    return "".join(r["text"] for r in df.where(F.col("run_id") == run).orderBy("ord").collect())


def test_json_report(cases):
    df = publish.test_report_json(cases, STAMP)
    got = json.loads(document(df, "r"))
    assert got["summary"] == {"total": 4, "passed": 1, "failed": 2, "skipped": 1, "pass_pct": 25.0}
    assert got["generated_at"] == STAMP
    assert [(s["name"], [c["name"] for c in s["cases"]]) for s in got["suites"]] == [
        ("pkg.B", ["b1", "b2"]), ("pkg.A", ["a1"]), ("pkg.C", ['c"<1>']),
    ]
    assert got["suites"][0]["cases"][0] == {
        "name": "b1", "status": "fail", "duration_ms": 1, "message": "first: 50%\nsecond", "file": "src/b.go", "line": 42,
    }
    assert got["suites"][1]["cases"][0] == {"name": "a1", "status": "pass", "duration_ms": 0}
    assert got["suites"][2]["cases"][0]["file"] == "src/c.go" and "line" not in got["suites"][2]["cases"][0]
    assert json.loads(document(df, "q"))["summary"]["passed"] == 1


def coverage_files(spark):
    return files(
        spark, ("r", "1", 1, "z.go", 10, 9), ("r", "1", 0, "a.go", 3, 1), ("r", "2", 0, "none.go", 0, 0)
    ).withColumns({
        "branch_total": F.when(F.col("path") == "a.go", F.lit(4)).otherwise(F.lit(0)).cast("bigint"),
        "branch_covered": F.when(F.col("path") == "a.go", F.lit(3)).otherwise(F.lit(0)).cast("bigint"),
    })


def test_json_coverage_report(spark):
    got = json.loads(document(publish.cov_report_json(coverage_files(spark), STAMP), "r"))
    assert got["summary"]["lines_total"] == 13 and got["summary"]["file_count"] == 3
    assert got["summary"]["func_total"] == 0 and got["summary"]["branch_pct"] == 75.0
    assert [f["path"] for f in got["files"]] == ["a.go", "z.go", "none.go"]
    assert got["files"][1] == {"path": "z.go", "lines_pct": 90.0, "lines_covered": 9, "lines_total": 10}
    assert got["files"][0]["branch_total"] == 4


def test_sarif(spark, cases):
    results = publish.test_sarif_results(cases)
    doc = publish.sarif_document(
        cases.select("run_id").distinct(), results, publish.test_sarif_rule(), "1.2", "https://example.org"
    )
    got = json.loads(document(doc, "r"))
    run = got["runs"][0]
    assert got["version"] == "2.1.0" and run["tool"]["driver"]["rules"][0]["id"] == "test-failure"
    assert [r["message"]["text"] for r in run["results"]] == ["b1: first: 50%\nsecond", "b2"]
    place = run["results"][0]["locations"][0]["physicalLocation"]
    assert place == {"artifactLocation": {"uri": "src/b.go", "uriBaseId": "%SRCROOT%"}, "region": {"startLine": 42}}
    assert "locations" not in run["results"][1]
    assert json.loads(document(doc, "q"))["runs"][0]["results"] == []

    low = publish.cov_sarif_results(coverage_files(spark), 90)
    texts = [json.loads(r["text"])["message"]["text"] for r in low.orderBy("place").collect()]
    assert texts == [
        "a.go: line coverage 33.3% is below the threshold of 90.0%.",
        "none.go: line coverage 0.0% is below the threshold of 90.0%.",
    ]
    assert publish.cov_sarif_results(coverage_files(spark), 0).count() == 0


def test_case_annotations(cases):
    def texts(platform):
        return [r["text"] for r in publish.test_annotations(cases, platform).orderBy("text").collect()]

    assert texts("github") == [
        "::error file=src/b.go,line=42,title=b1::first%3A 50%25",
        "::error title=b2::test failed",
    ]
    assert texts("gitlab") == [
        "\x1b[31mFAIL\x1b[0m  pkg.B :: b1 — first: 50%", "\x1b[31mFAIL\x1b[0m  pkg.B :: b2 — test failed",
    ]
    assert texts("azure") == [
        "##vso[task.logissue type=error;sourcepath=pkg/B;title=b2]test failed",
        "##vso[task.logissue type=error;sourcepath=src/b.go;linenumber=42;title=b1]first: 50%",
    ]
    with pytest.raises(ValueError):
        publish.test_annotations(cases, "auto")


def test_coverage_annotations(spark):
    df = coverage_files(spark)
    assert [r["text"] for r in publish.cov_annotations(df, 95, "github").collect()] == [
        "::warning file=a.go,title=Low Coverage::33.3%25 line coverage (1/3 lines) — threshold 95.0%25",
        "::warning file=z.go,title=Low Coverage::90.0%25 line coverage (9/10 lines) — threshold 95.0%25",
        "::error title=Coverage Below Threshold::overall line coverage 76.9%25 is below threshold 95.0%25",
    ]
    assert publish.cov_annotations(df, 0, "gitlab").count() == 0
    assert [r["text"] for r in publish.cov_annotations(df, 50, "azure").collect()] == [
        "##vso[task.logissue type=warning;sourcepath=a.go]33.3% line coverage (1/3 lines) — threshold 50.0%",
    ]


def test_markdown(spark, cases):
    text = "\n".join(r["text"] for r in publish.test_markdown_rows(cases, STAMP).where("run_id = 'r'").orderBy("ord").collect())
    assert text.startswith(f"## Test Report\n\n_Generated: {STAMP}_\n\n| Metric | Value |\n|--------|-------|\n| **Total** | 4 |")
    assert "| Pass rate | 25.0% |\n\n### ❌ Failed Tests\n\n#### `pkg.B / b1`\n\n```\nfirst: 50%\nsecond\n```\n" in text
    assert "<details><summary>Output</summary>\n\n```\nout\nput\n```\n\n</details>" in text and "hidden" not in text
    quiet = publish.test_markdown_rows(cases, STAMP).where("run_id = 'q' AND text LIKE '%Failed Tests%'")
    assert quiet.count() == 0

    text = "\n".join(r["text"] for r in publish.cov_markdown_rows(coverage_files(spark), STAMP).orderBy("ord").collect())
    assert "| 🟡 Lines | 10 | 13 | 76.9% |\n| 🟡 Branches | 3 | 4 | 75.0% |\n\n<details><summary>Per-file coverage (3 files)" in text
    assert "| `a.go` | 33.3% | 1/3 | 75.0% | – |\n| `z.go` | 90.0% | 9/10 | – | – |" in text
    assert text.endswith("\n</details>\n")


def test_documents_are_written_in_order(spark, cases, tmp_path):
    rows_ = publish.test_report_json(cases, STAMP)
    for whole in (False, True):
        path = tmp_path / f"out-{whole}"
        publish.write_documents(rows_, str(path), whole_files=whole)
        parts = sorted((path / "run_id=r").glob("part-*"))
        assert json.loads("".join(p.read_text() for p in parts))["summary"]["total"] == 4
        assert not whole or len(parts) == 1


def snapshot(spark, cases):
    df = coverage_files(spark)
    stamp = F.to_timestamp(F.lit("2024-05-01 10:00:00"))
    return deltas.build_snapshots(cases, df, stamp, F.lit("main")), deltas.snapshot_files(df)


def test_snapshot_roundtrip(spark, cases, tmp_path):
    snaps, shares = snapshot(spark, cases)
    publish.write_snapshots(snaps, shares, str(tmp_path / "snap"))
    written = json.loads(next((tmp_path / "snap" / "run_id=r").glob("part-*")).read_text())
    assert written["version"] == 1 and written["timestamp"] == "2024-05-01T10:00:00Z" and written["label"] == "main"
    assert written["tests"] == {"total": 4, "passed": 1, "failed": 2, "skipped": 1}
    assert written["coverage"]["files"]["z.go"] == 90.0 and written["coverage"]["lines_covered"] == 10
    inputs = artifacts(str(tmp_path / "snap"), run_id=F.regexp_extract(F.col("source"), r"run_id=([^/]+)", 1))
    loaded = read_snapshots(spark, inputs)
    columns = [c for c in snaps.columns if c != "file_count"]
    back = flat_snapshots(loaded)
    assert rows(back, *columns) == rows(snaps, *columns)
    assert rows(loaded_files(loaded), "run_id", "path", "line_pct") == rows(shares, "run_id", "path", "line_pct")
    tests_only = publish.snapshot_documents(snaps.where("run_id = 'q'"))
    assert set(json.loads(document(tests_only, "q"))) == {"version", "timestamp", "label", "tests"}


@pytest.mark.parametrize("text", ['{"version": 999}', '{"version": 1, "tests": ['])
def test_bad_snapshots_fail(spark, tmp_path, text):
    folder = tmp_path / "run"
    folder.mkdir()
    Path(folder / "s.json").write_text(text)
    with pytest.raises(Exception):
        read_snapshots(spark, artifacts(str(folder))).collect()
    with pytest.raises(Exception):
        read_snapshots(spark, artifacts(str(tmp_path / "missing"))).collect()


def test_badges_and_payloads(spark, cases):
    snaps, _ = snapshot(spark, cases)
    badges = rows(deltas.badge_rows(snaps), "run_id", "label", "value", "colour", "label_width", "value_width")
    assert badges == [
        ("q", "tests", "1/1", "#4c1", 59, 45), ("r", "coverage", "76.9%", "#dfb317", 80, 59), ("r", "tests", "1/4", "#e05d44", 59, 45),
    ]
    bodies = {(r["run_id"], r["kind"]): json.loads(r["body"]) for r in publish.notify_payload_rows(snaps, STAMP).collect()}
    assert bodies["r", "tests"]["pass_pct"] == 25.0
    assert bodies["r", "coverage"]["branch_pct"] == 75.0 and "func_pct" not in bodies["r", "coverage"]
    assert bodies["r", "coverage"]["file_count"] == 3 and ("q", "coverage") not in bodies


def test_titles(spark):
    df = spark.createDataFrame([("", "a", 1), ("", "a", 3), ("T", "a", 3), ("", None, 0)], "t string, f string, n int")
    got = df.select(
        publish.report_title(F.col("t"), F.col("f"), F.col("n")), publish.cov_report_title(F.col("t"), F.col("f"), F.col("n"))
    )
    assert [tuple(r) for r in got.collect()] == [
        ("a", "a"), ("a (+2 more)", "Coverage Report"), ("T", "T"), ("Test Report", "Coverage Report"),
    ]
