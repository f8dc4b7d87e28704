"""Files as inputs: formats recognised by their first bytes, files of zero bytes, formats added by the caller."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.catalog import base
from buildlens.catalog.base import query, with_tables
from buildlens.catalog.functions import choose
from buildlens.catalog.roundtrips import DOC_CASES, doc_number, located
from buildlens.functions.numbers import nanos_to_millis
from buildlens.schemas import REJECTS, TEST_RUNS, record_seq
from buildlens.session import materialize, scratch_path
from buildlens.sources import facts, registry
from buildlens.sources.cucumber import ingest_cucumber
from buildlens.sources.ingest import ingest_tests
from buildlens.sources.listing import file_system, plain_name, task_count
from buildlens.sources.scan import Artifacts, list_sources, scan_artifacts
from buildlens.sources.tap import ingest_tap


def write_files(rows: DataFrame, label: str) -> str:
    """Write each row's `text` to a file `name` below a fresh folder, byte by byte, and return the folder."""
    path = scratch_path(rows.sparkSession, label)
    root = plain_name(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner, _ = file_system(root)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, text in zip(names, texts):
                folder, _, _ = f"{inner}/{name}".rpartition("/")
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{inner}/{name}", compression=None) as file:
                    file.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["files"])

    rows.select("name", "text").repartition(task_count(rows.sparkSession)).mapInArrow(run, "files long").write.format(
        "noop"
    ).mode("overwrite").save()
    return path


# Detection

_FILLER = "x" * 600
_HEADS = [
    # (name, text, test format, test format by content, coverage format)
    ("a.xml", "<test-run id='1'>", "junit", "nunit", "cobertura"),
    ("features", '[{"uri": "a.feature"', "cucumber", "cucumber", "-"),
    ("b.json", '{"Action":"run","Package":"p"}', "gotest", "gotest", "-"),
    ("c.log", "<?xml version='1.0'?><assemblies>", "nunit", "nunit", "-"),
    ("d.TAP", "anything", "tap", "tap", "-"),
    ("e", f" 1..4\n{_FILLER}", "tap", "tap", "-"),
    ("late", f"{_FILLER}<testsuite name='behind the first bytes'>", "-", "-", "-"),
    ("f.out", "mode: set", "-", "-", "gocover"),
    ("g.txt", f"TN:\nSF:a\n{_FILLER}", "-", "-", "lcov"),
    ("none", "", "-", "-", "-"),
]


def _head_columns(as_sql: bool) -> list:
    return [choose("s_suppkey", [h[i] for h in _HEADS], as_sql) for i in range(5)]


@query(
    "SELECT concat('run=', CAST(s_suppkey % 7 AS VARCHAR), '/', CAST(s_suppkey AS VARCHAR), '-', {0}) AS name, "
    "{2} AS test_format, {3} AS by_content, {4} AS cov_format FROM supplier".format(*_head_columns(True))
)
def detect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of real files, one of each supplier: by name, else by at most 512 bytes."""
    name, text, *_ = _head_columns(False)
    run, key = (F.col("s_suppkey") % 7).cast("string"), F.col("s_suppkey").cast("string")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    files = suppliers.select(F.concat(F.lit("run="), run, F.lit("/"), key, F.lit("-"), name).alias("name"), text.alias("text"))
    inputs = located(write_files(files, "detect"))

    def found(kind: str, column: str, trust_extension: bool = True) -> DataFrame:
        rows = registry.detect_artifacts(spark, inputs, kind, trust_extension)
        return rows.select(
            F.regexp_extract("source", "(run=[^/]+/[^/]+)$", 1).alias("name"), F.coalesce("format", F.lit("-")).alias(column)
        )

    tests = materialize(found(registry.TESTS, "test_format"), "detected")
    by_content = found(registry.TESTS, "by_content", trust_extension=False)
    return tests.join(by_content, "name").join(found(registry.COVERAGE, "cov_format"), "name")


# Zero bytes

_DOC = f"CAST(seq // {DOC_CASES * 4} AS INT)"
_EVERY = 3  # every so many-th document is empty


@query(
    with_tables("cases")
    + f"""SELECT run_id, doc, CAST(1 AS BIGINT) AS tap_sources, CASE WHEN doc % {_EVERY} = 1 THEN 0 ELSE n END AS tap_cases,
        CAST(CASE WHEN doc % {_EVERY} = 1 THEN 1 ELSE 0 END AS BIGINT) AS cucumber_rejects,
        CAST(CASE WHEN doc % {_EVERY} = 1 THEN 0 ELSE 1 END AS BIGINT) AS cucumber_sources
        FROM (SELECT run_id, {_DOC} AS doc, count(*) AS n FROM cases GROUP BY ALL)"""
)
def empty_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents some of which have zero bytes: nothing in them where lines are read, a reject where a document is."""
    cases = base.cases(spark, sf_dir).withColumn("doc", doc_number())
    full = F.col("doc") % _EVERY != 1

    def files(line, head: str, between: str, foot: str) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct("seq", line.alias("text"))))
        text = F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["text"]), between), F.lit(foot))
        name = F.concat(F.lit("run="), "run_id", F.lit("/doc="), F.col("doc").cast("string"))
        return cases.groupBy("run_id", "doc").agg(text.alias("text")).select(
            name.alias("name"), F.when(full, F.col("text")).otherwise("").alias("text")
        )

    tap = ingest_tap(spark, located(write_files(files(F.concat(F.lit("ok 1 - "), "name"), "", "\n", "\n"), "empty-tap")))
    feature = F.concat(F.lit('{"uri": "'), "name", F.lit('", "elements": []}'))
    cucumber = ingest_cucumber(spark, located(write_files(files(feature, "[", ",", "]"), "empty-cucumber")))
    rows = [(tap.runs, "tap_sources"), (tap.cases, "tap_cases"), (cucumber.rejects, "cucumber_rejects"), (cucumber.runs, "cucumber_sources")]
    parts = None
    for df, column in rows:
        doc = F.regexp_extract("source", r"doc=(\d+)$", 1).cast("int").alias("doc")
        part = df.select("run_id", doc, F.lit(column).alias("kind"))
        parts = part if parts is None else parts.unionByName(part)
    counts = [F.count(F.when(F.col("kind") == column, 1)).alias(column) for _, column in rows]
    return parts.groupBy("run_id", "doc").agg(*counts)


# A format of the caller's

_PLUGIN = "plainlog"


def _ingest_plain(spark: SparkSession, inputs: Artifacts) -> facts.TestFacts:
    """Lines `status milliseconds suite name` below a first line that names the format."""
    lines = scan_artifacts(spark, inputs).where(F.col("value") != "!plainlog")
    words = F.split("value", " ", 4)
    cases = facts.test_cases(
        lines, suite=words[2], name=words[3], status=words[0], duration_ns=words[1].cast("bigint") * 1_000_000,
        seq=record_seq(F.col("seq")),
    )
    runs = facts.test_runs(list_sources(spark, inputs), duration_ns=F.lit(0))
    return facts.TestFacts(cases, runs.select(*TEST_RUNS), facts.no_rows(lines, REJECTS))


@query(
    with_tables("cases")
    + f"SELECT run_id, {_DOC} AS doc, suite, name, status, duration_ms FROM cases"
)
def registered_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a format that the caller registered, recognised by their first line and read with it."""
    fields = [F.col("status"), nanos_to_millis(F.col("duration_ns")).cast("string"), F.col("suite"), F.col("name")]
    cases = base.cases(spark, sf_dir).withColumn("doc", doc_number())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", *fields).alias("text")))), lambda x: x["text"])
    name = F.concat(F.lit("run="), "run_id", F.lit("/doc="), F.col("doc").cast("string"))
    files = cases.groupBy("run_id", "doc").agg(F.array_join(lines, "\n").alias("text")).select(
        name.alias("name"), F.concat(F.lit("!plainlog\n"), "text").alias("text")
    )
    detect = registry.Format(_PLUGIN, (), lambda head: head.startswith("!plainlog"), _ingest_plain)
    registry.register_format(registry.TESTS, detect)
    try:
        found = ingest_tests(spark, located(write_files(files, "plainlog"))).cases
    finally:
        registry.unregister_format(registry.TESTS, _PLUGIN)
    return found.select(
        "run_id", F.regexp_extract("source", r"doc=(\d+)$", 1).cast("int").alias("doc"), "suite", "name", "status",
        nanos_to_millis(F.col("duration_ns")).alias("duration_ms"),
    )
