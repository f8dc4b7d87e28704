"""`go test -json` event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import seconds_to_nanos
from buildlens.functions.text import blank_to_null, go_fail_message, go_skip_reason, trim_space
from buildlens.operators.cases import run_duration
from buildlens.plans.linestate import CHUNK_BITS, neighbour_markers
from buildlens.plans.skew import parts_for
from buildlens.schemas import REJECTS, record_seq
from buildlens.session import materialize
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, list_sources, scan_artifacts

EVENT = "Time STRING, Action STRING, Package STRING, Test STRING, Elapsed DOUBLE, Output STRING"
TERMINAL = ("pass", "fail", "skip")
_TEST_KEY = ["run_id", "source", "source_ord", "package", "test"]


def gotest_events(lines: DataFrame) -> DataFrame:
    """Events of single tests; package-level and garbled lines fall out."""
    event = F.from_json("value", EVENT)
    return (
        lines.withColumn("event", event)
        .where((F.col("event.Test") != "") & F.col("event.Action").isin("run", "output", *TERMINAL))
        .select(
            "run_id", "source", "source_ord", "seq",
            F.coalesce("event.Package", F.lit("")).alias("package"),
            F.col("event.Test").alias("test"),
            F.col("event.Action").alias("action"),
            F.coalesce("event.Elapsed", F.lit(0.0)).alias("elapsed"),
            F.coalesce("event.Output", F.lit("")).alias("output"),
        )
    )


def gotest_segments(events: DataFrame, chunk_bits: int = CHUNK_BITS, parts: int | None = None) -> DataFrame:
    """Output text per finished test that failed or was skipped.

    A `run` event opens a buffer and a terminal event closes it, so an output
    row belongs to the run before it and the terminal after it. Output of
    passing tests is never needed and is dropped before it is gathered.
    """
    boundary = F.when(
        F.col("action") != "output", F.struct(F.col("action").alias("action"), F.col("seq").alias("at"))
    )
    placed = neighbour_markers(
        events.where((F.col("action") != "output") | (F.col("output") != "")).withColumn("boundary", boundary),
        _TEST_KEY, "boundary", chunk_bits=chunk_bits, parts=parts,
    )
    wanted = placed.where(
        (F.col("action") == "output")
        & (F.col("prev_marker.action") == "run")
        & F.col("next_marker.action").isin("fail", "skip")
    )
    pieces = F.array_sort(F.collect_list(F.struct("seq", "output")))
    return wanted.groupBy(*_TEST_KEY, F.col("next_marker.at").alias("seq")).agg(
        F.array_join(F.transform(pieces, lambda p: p["output"]), "").alias("raw_output")
    )


def suite_of_package(package: Column) -> Column:
    return F.when(package == "", F.lit("default")).otherwise(package)


def finished_cases(finished: DataFrame) -> DataFrame:
    """Cases of terminal events that carry their `raw_output`."""
    out = F.coalesce("raw_output", F.lit(""))
    failed, skipped = F.col("action") == "fail", F.col("action") == "skip"
    return facts.test_cases(
        finished,
        suite=suite_of_package(F.col("package")),
        seq=record_seq(F.col("seq")),
        name=F.col("test"),
        status=F.col("action"),
        duration_ns=seconds_to_nanos(F.col("elapsed")),
        message=blank_to_null(F.when(failed, go_fail_message(out)).when(skipped, go_skip_reason(out))),
        stdout=blank_to_null(F.when(failed, trim_space(out))),
    )


def ingest_gotest(spark: SparkSession, inputs: Artifacts, chunk_bits: int = CHUNK_BITS) -> facts.TestFacts:
    """One case per terminal event; tests without one are dropped."""
    lines = scan_artifacts(spark, inputs)
    events = materialize(gotest_events(lines), "gotest")
    terminal = events.where(F.col("action").isin(*TERMINAL)).drop("output")
    noisy = terminal.where(F.col("action") != "pass").join(
        gotest_segments(events, chunk_bits, parts_for(events.count(), events)), [*_TEST_KEY, "seq"], "left"
    )
    quiet = terminal.where(F.col("action") == "pass").withColumn("raw_output", F.lit(None).cast("string"))
    elapsed = F.when(F.col("action").isin(*TERMINAL), seconds_to_nanos(F.col("elapsed")))
    durations = events.groupBy("source").agg(run_duration("gotest", elapsed, F.col("seq")).alias("total"))
    runs = facts.timed_runs(list_sources(spark, inputs), durations)
    return facts.TestFacts(
        finished_cases(noisy.unionByName(quiet)), runs, facts.no_rows(lines, REJECTS)
    )
