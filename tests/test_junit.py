from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from buildlens.operators.cases import test_stats as stats_of
from buildlens.sources.junit import ingest_junit, normalize_suite
from buildlens.sources.scan import artifacts


def ingest(spark, folder, **kw):
    return ingest_junit(spark, artifacts(folder), **kw)


def test_times_and_counts(spark, put):
    folder = put(
        {
            "a.xml": """<?xml version="1.0"?>
<testsuites time="1.5"><testsuite name="S" time="9">
  <testcase name="one" classname="pkg.A" time="0.5"/>
  <testcase name="two" classname="pkg.A" time="-3"><failure message=" bad "><![CDATA[trace <testcase/>]]></failure>
    <system-out> out [[ATTACHMENT|shots/a.png]] and [[ATTACHMENT|]] [[ATTACHMENT| b.txt ]]</system-out></testcase>
  <testsuite name="inner"><testcase name="three" classname="pkg.B" time="x"><error>boom</error></testcase></testsuite>
  <testcase name="four" classname="pkg.B"><skipped/></testcase>
</testsuite></testsuites>"""
        }
    )
    got = ingest(spark, folder)
    assert rows(got.cases, "name", "suite", "status", "duration_ns", "message") == [
        ("four", "pkg.B", "skip", 0, None),
        ("one", "pkg.A", "pass", 500_000_000, None),
        ("three", "pkg.B", "fail", 0, "boom"),
        ("two", "pkg.A", "fail", 0, "bad"),
    ]
    two = got.cases.where("name = 'two'").first()
    assert two["attachments"] == ["shots/a.png", "b.txt"]
    assert two["stdout"].startswith("out [[ATT")
    assert rows(stats_of(got.cases), "run_id", "total", "passed", "failed", "skipped") == [("run1", 4, 1, 2, 1)]
    assert rows(got.runs, "run_id", "duration_ns") == [("run1", 1_500_000_000)]
    order = [r["name"] for r in got.cases.orderBy("seq").collect()]
    assert order == ["one", "two", "three", "four"]


def test_ctest_skip_reason_and_location(spark, put):
    folder = put(
        {
            "a.xml": """<testsuite timestamp="2024-03-01T10:00:00">
<testcase name="net" classname="c"><skipped message="SKIP_REGULAR_EXPRESSION_MATCHED"/>
<system-out>probing the bus
 bus probe Skipped: no device on port 3: giving up
</system-out></testcase>
<testcase name="loc" file="lib/crate.cxx" line="77"/></testsuite>"""
        }
    )
    got = ingest(spark, folder)
    assert rows(got.cases, "name", "message", "file", "line", "suite") == [
        ("loc", None, "lib/crate.cxx", 77, "lib/crate.cxx"),
        ("net", "no device on port 3: giving up", None, None, "c"),
    ]
    assert str(got.runs.first()["ts"]) == "2024-03-01 10:00:00"


def test_malformed_file_is_rejected_and_others_stay(spark, put):
    folder = put(
        {
            "bad.xml": '<testsuite><testcase name="a" classname="s"/><testcase name="b"',
            "good.xml": '<testsuite><testcase name="c" classname="s"/></testsuite>',
            "empty.xml": "",
        }
    )
    got = ingest(spark, folder)
    assert rows(got.cases, "name") == [("c",)]
    assert [r["source"].split("/")[-1] for r in got.rejects.collect()] == ["bad.xml"]


def test_retries(spark, put):
    def case(name, body="", time="1"):
        return f'<testcase name="{name}" classname="s" time="{time}">{body}</testcase>'

    fail, skip = "<failure message='no'/>", "<skipped/>"
    folder = put(
        {
            "a.xml": "<testsuite>"
            + case("flaky", fail, "1") + case("once") + case("flaky", "", "2") + case("flaky", "", "3")
            + case("flaky", fail, "4") + case("twice", "", "5") + case("twice", "", "6")
            + case("broken", fail, "7") + case("broken", skip, "8")
            + "</testsuite>",
            "b.xml": "<testsuite>" + case("twice", "", "9") + "</testsuite>",
        }
    )
    got = ingest(spark, folder)
    one = got.cases.where(F.col("source").endswith("a.xml"))
    assert [(r["name"], r["status"], r["duration_ns"] // 10**9) for r in one.orderBy("seq").collect()] == [
        ("flaky", "flaky", 3), ("once", "pass", 1), ("twice", "pass", 5), ("broken", "fail", 7),
    ]
    # Inputs are not collapsed against each other.
    assert got.cases.where("name = 'twice'").count() == 2
    assert ingest(spark, folder, collapse=False).cases.count() == 10


def test_suite_names(spark):
    cases = [
        ("net.depot.CrateLoad", "", "fillsUp", "net.depot.CrateLoad"),
        ("net.depot.CrateLoad.fillsUp", "", "fillsUp", "net.depot.CrateLoad"),
        ("pytest", "tests/a.py", "t", "tests/a.py"),
        (" AllTests ", "", "t", "t"),
        (".", "", "t", "t"),
        ("a/b/c/d/e.py", "", "t", "c/d/e.py"),
        ("a\\b\\c\\d", "", "t", "b/c/d"),
        ("dir.x/y.t", "", "t", "dir.x/y.t"),
        ("main.go", "", "go", "main.go"),
        ("x.PY", "", "PY", "x.PY"),
        (".hidden", "", "hidden", ".hidden"),
    ]
    df = spark.createDataFrame(cases, "c string, f string, n string, want string")
    got = df.withColumn("got", normalize_suite(F.col("c"), F.col("f"), F.col("n")))
    assert [(r["c"], r["got"]) for r in got.collect()] == [(c[0], c[3]) for c in cases]


def test_timestamps_do_not_depend_on_the_session_zone(spark, put):
    folder = put(
        {
            "a.xml": '<testsuites timestamp="bad"><testsuite timestamp="2024-01-01T12:00:00.5+02:00"/></testsuites>',
            "b.xml": '<testsuite timestamp="2024-01-01T12:00:00"/>',
        }
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        runs = ingest(spark, folder).runs.select(F.unix_millis("ts").alias("ms"))
        assert rows(runs, "ms") == [(1704103200500,), (1704110400000,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
