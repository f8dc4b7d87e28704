"""Values beyond their type, very long ranges, and runs with nothing in them."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from buildlens.functions.numbers import RANGE_PIECE, numbers_between
from buildlens.operators import cases, coverage, gates
from buildlens.schemas import ENTRY_KEYS
from buildlens.sources.clover import ingest_clover
from buildlens.sources.gocover import ingest_gocover
from buildlens.sources.junit import ingest_junit
from buildlens.sources.scan import artifacts
from buildlens.sources.tap import ingest_tap


def test_a_line_number_beyond_its_type_is_null(spark, put):
    folder = put(
        {
            "a.xml": '<testsuite name="S"><testcase name="a" file="f" line="99999999999"/>'
            '<testcase name="b" file="f" line="7"/></testsuite>'
        }
    )
    assert rows(ingest_junit(spark, artifacts(folder)).cases, "name", "line") == [("a", None), ("b", 7)]


def test_ranges_come_in_pieces(spark):
    df = spark.createDataFrame([(1, 3), (5, 4), (7, 7), (10, 10 + 2 * RANGE_PIECE)], "a long, b long")
    got = numbers_between(df, "a", "b", "n").groupBy("a").agg(F.count("*"), F.min("n"), F.max("n"), F.countDistinct("n"))
    size = 2 * RANGE_PIECE + 1
    assert sorted(map(tuple, got.collect())) == [(1, 3, 1, 3, 3), (7, 1, 7, 7, 1), (10, size, 10, 9 + size, size)]


def test_a_block_of_very_many_lines(spark, put):
    got = ingest_gocover(spark, artifacts(put({"c.out": "mode: set\na.go:1.1,300000.2 1 1\na.go:2.1,3.1 1 0\n"})))
    assert got.lines.agg(F.count("*"), F.max("line"), F.sum("hits")).first()[:] == (300000, 300000, 300000)


def test_a_file_with_totals_only(spark, put):
    xml = """<coverage><project><file name="a.php" path="/s/a.php"><metrics statements="200000" coveredstatements="150000"/></file>
<file name="b.php" path="/s/b.php"><line num="4" type="stmt" count="2"/><metrics statements="9" coveredstatements="9"/></file>
<file name="c.php" path="/s/c.php"><metrics statements="0" coveredstatements="0"/></file></project></coverage>"""
    got = ingest_clover(spark, artifacts(put({"clover.xml": xml})))
    totals = got.lines.groupBy("path").agg(F.count("*").alias("n"), F.sum((F.col("hits") > 0).cast("int")).alias("hit"))
    assert rows(totals, "path", "n", "hit") == [("/s/a.php", 200000, 150000), ("/s/b.php", 1, 1)]
    assert rows(got.entries, "path") == [("/s/a.php",), ("/s/b.php",), ("/s/c.php",)]


def test_runs_with_nothing_in_them(spark, put):
    tests = ingest_tap(spark, artifacts(put({"a.tap": "1..0\n"}, "empty"), put({"b.tap": "not ok 1 - x\n"}, "full")))
    stats = cases.test_stats(tests.cases, runs=tests.runs)
    assert rows(stats, "run_id", "total", "failed") == [("empty", 0, 0), ("full", 1, 1)]
    assert rows(gates.test_gate(stats), "run_id", "gate_failed") == [("empty", False), ("full", True)]
    assert rows(cases.with_status_pcts(stats).where("total = 0"), "pass_pct") == [(0.0,)]

    cov = ingest_gocover(spark, artifacts(put({"c.out": "mode: set\n"}, "empty"), put({"d.out": "mode: set\na.go:1.1,1.2 1 1\n"}, "full")))
    files = coverage.cov_file_totals(cov.entries, cov.lines, cov.branches, cov.funcs, ENTRY_KEYS)
    stats = coverage.cov_stats(files, runs=cov.runs)
    assert rows(stats, "run_id", "file_count", "line_pct") == [("empty", 0, 0.0), ("full", 1, 100.0)]
    assert gates.coverage_gate(stats, line=50).where("failed").select("run_id", "metric").collect() == [("empty", "line")]
