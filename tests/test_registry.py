from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from buildlens.operators.cases import test_stats as stats_of
from buildlens.schemas import REJECTS, TEST_RUNS, record_seq
from buildlens.sources import facts, registry
from buildlens.sources.ingest import ingest_coverage, ingest_tests
from buildlens.sources.registry import COVERAGE, TESTS, Format
from buildlens.sources.scan import artifacts, scan_artifacts


def test_aliases(spark):
    assert registry.resolve_format(TESTS, " GTest ").name == "junit"
    assert registry.resolve_format(TESTS, "xunit").name == "nunit"
    assert registry.resolve_format(COVERAGE, "go-cover").name == "gocover"
    assert registry.resolve_format(COVERAGE, "jacoco").name == "jacoco"
    for kind in (TESTS, COVERAGE):
        with pytest.raises(ValueError):
            registry.resolve_format(kind, "nope")
    names = spark.createDataFrame([(n,) for n in ("Info", "clover ", "tap", "jacoco")], "n string")
    got = names.select("n", registry.resolve_format_alias(F.col("n"), COVERAGE).alias("f"))
    assert rows(got, "n", "f") == [("Info", "lcov"), ("clover ", "clover"), ("jacoco", "jacoco"), ("tap", None)]


def test_detection_of_files(spark, put):
    folder = put(
        {
            "nunit.xml": "<test-run/>", "a.tap": "x", "go.json": '{"Action":"run","Package":"p"}', "noext": "1..3\nok 1",
            "c.json": ' [{"elements": []}]', "late.txt": " " * 600 + "1..3", "what.bin": "?",
        }
    )

    def detected(**kw):
        found = registry.detect_artifacts(spark, artifacts(folder), TESTS, **kw)
        return {r["source"].rsplit("/", 1)[1]: r["format"] for r in found.collect()}, found

    got, found = detected()
    assert got == {
        "nunit.xml": "junit", "a.tap": "tap", "go.json": "gotest", "noext": "tap", "c.json": "cucumber",
        "late.txt": None, "what.bin": None,
    }
    assert registry.undetected(found).count() == 2
    by_content, _ = detected(trust_extension=False)
    assert by_content["nunit.xml"] == "nunit" and by_content["a.tap"] == "tap"


def test_a_plug_in_format(spark, put):
    """A format is DataFrame code: here, lines of `status name`."""

    def ingest(spark, inputs):
        lines = scan_artifacts(spark, inputs).where(F.col("value") != "!plain")
        words = F.split("value", " ", 2)
        case_rows = facts.test_cases(
            lines, suite=F.lit("plain"), name=words[1], status=words[0], duration_ns=F.lit(0),
            seq=record_seq(F.col("seq")),
        )
        return facts.TestFacts(
            case_rows, facts.no_rows(lines, TEST_RUNS), facts.no_rows(lines, REJECTS)
        )

    registry.register_format(TESTS, Format("plain", ("plain",), lambda head: head.startswith("!plain"), ingest))
    try:
        folder = put({"a.plain": "!plain\npass one\nfail two", "b": "!plain\npass three"})
        found = registry.detect_artifacts(spark, artifacts(folder), TESTS)
        assert {r["format"] for r in found.collect()} == {"plain"}
        got = ingest_tests(spark, artifacts(folder))
        assert rows(stats_of(got.cases), "total", "passed", "failed") == [(3, 2, 1)]
    finally:
        registry.unregister_format(TESTS, "plain")


def test_names_with_odd_characters(spark, put):
    folder = put({"a b+c%20ü.tap": "ok 1 x"}, run="run ä+1")
    row = scan_artifacts(spark, artifacts(folder)).first()
    assert row["source"].endswith("/run ä+1/a b+c%20ü.tap") and row["run_id"] == "run ä+1"


MIXED = {
    "a.xml": '<testsuite><testcase name="x" classname="S"/></testsuite>',
    "b{1}.json": '{"Action":"run","Package":"p","Test":"T"}\n{"Action":"fail","Package":"p","Test":"T"}',
    "c.tap": "1..2\nok 1 a\nnot ok 2 b",
    "d.log": '<test-run><test-suite name="N"><test-case name="n" result="Passed"/></test-suite></test-run>',
    "e": '[{"uri":"u","elements":[{"name":"s","steps":[{"result":{"status":"skipped"}}]}]}]',
    "f.bin": "?",
}


def test_mixed_inputs_are_read_by_their_own_format(spark, put):
    folder = put(MIXED)
    got = ingest_tests(spark, artifacts(folder))
    assert rows(got.cases, "name", "status") == [
        ("T", "fail"), ("a", "pass"), ("b", "fail"), ("n", "pass"), ("s", "skip"), ("x", "pass"),
    ]
    assert [r["source"].rsplit("/", 1)[1] for r in got.rejects.collect()] == ["f.bin"]
    assert rows(stats_of(got.cases), "run_id", "total", "failed") == [("run1", 6, 2)]


def test_forced_and_detected_coverage(spark, put):
    folder = put({"a.info": "SF:/ci/a.c\nDA:1,1\nend_of_record\n", "b.out": "mode: set\n/ci/b.go:1.1,2.2 1 0\n"})
    got = ingest_coverage(spark, artifacts(folder), prefix="/ci")
    assert rows(got.lines, "path", "line", "hits") == [("a.c", 1, 1), ("b.go", 1, 0), ("b.go", 2, 0)]
    forced = ingest_coverage(spark, artifacts(folder + "/a.info"), fmt="Info")
    assert rows(forced.entries, "path") == [("/ci/a.c",)]
    with pytest.raises(ValueError):
        ingest_coverage(spark, artifacts(folder), fmt="nope")
