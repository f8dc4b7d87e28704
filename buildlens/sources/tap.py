"""TAP 12 and 13 streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import seconds_to_nanos
from buildlens.functions.text import blank_to_null, trim_space
from buildlens.operators.cases import run_duration
from buildlens.plans.linestate import CHUNK_BITS, neighbour_markers
from buildlens.schemas import REJECTS, record_seq
from buildlens.session import materialize
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, list_sources, scan_artifacts

# The line and annotation patterns of the format.
TEST_LINE = r"(?s)^(ok|not ok)[\t\n\f\r ]+[0-9]+[\t\n\f\r ]*(?:-[\t\n\f\r ]*)?(.*)"
SKIP_NOTE = r"(?is)#\s*SKIP\b\s*(.*)"
TIME_NOTE = r"(?i)#\s*time=([0-9]+(?:\.[0-9]+)?)"


def _yaml_marker() -> Column:
    text = trim_space(F.col("value"))
    return F.when(text.startswith("---"), F.lit("open")).when(text == "...", F.lit("closed"))


def tap_yaml_mask(lines: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Test lines outside YAML blocks.

    A line that starts with `---` opens a block and `...` closes it. Only
    markers and test lines take part in the ordering.
    """
    relevant = lines.withColumn("yaml", _yaml_marker()).where(
        F.col("yaml").isNotNull() | F.col("value").rlike(TEST_LINE)
    )
    placed = neighbour_markers(relevant, ["run_id", "source", "source_ord"], "yaml", chunk_bits=chunk_bits)
    inside = F.coalesce(F.col("prev_marker") == "open", F.lit(False))
    return placed.where(F.col("yaml").isNull() & ~inside).drop("yaml", "prev_marker", "next_marker")


def tap_fields(line: Column) -> dict[str, Column]:
    """name, status, message and seconds of a test line."""
    ok = F.regexp_extract(line, TEST_LINE, 1) == "ok"
    desc = trim_space(F.regexp_extract(line, TEST_LINE, 2))
    seconds = F.regexp_extract(desc, TIME_NOTE, 1).try_cast("double")
    timed = trim_space(F.regexp_replace(desc, TIME_NOTE, ""))
    desc = F.rtrim(F.when(seconds.isNotNull(), timed).otherwise(desc), F.lit(" \t#"))

    skipped = desc.rlike(SKIP_NOTE)
    note_at = F.length(desc) - F.length(F.substring_index(desc, " # ", -1))  # 0 without a note
    has_note = ~ok & ~skipped & desc.contains(" # ")
    name = (
        F.when(skipped, trim_space(F.regexp_replace(desc, SKIP_NOTE, "")))
        .when(has_note, trim_space(F.substr(desc, F.lit(1), note_at - 3)))
        .otherwise(desc)
    )
    message = F.when(skipped, trim_space(F.regexp_extract(desc, SKIP_NOTE, 1))).when(
        has_note, trim_space(F.substring_index(desc, " # ", -1))
    )
    return {
        "name": F.when(name == "", F.lit("test")).otherwise(name),
        "status": F.when(skipped, "skip").when(ok, "pass").otherwise("fail"),
        "message": blank_to_null(message),
        "duration_ns": F.coalesce(seconds_to_nanos(seconds), F.lit(0).cast("bigint")),
    }


def ingest_tap(spark: SparkSession, inputs: Artifacts, chunk_bits: int = CHUNK_BITS) -> facts.TestFacts:
    """One case per test line; the suite is named after the source."""
    scanned = scan_artifacts(spark, inputs)
    relevant = _yaml_marker().isNotNull() | F.col("value").rlike(TEST_LINE)
    lines = materialize(scanned.where(relevant), "tap")
    cases = facts.test_cases(
        tap_yaml_mask(lines, chunk_bits),
        suite=F.col("source"),
        seq=record_seq(F.col("seq")),
        **tap_fields(F.col("value")),
    )
    durations = cases.groupBy("source").agg(
        run_duration("tap", F.col("duration_ns"), F.col("seq")).alias("total")
    )
    runs = facts.timed_runs(list_sources(spark, inputs), durations)
    return facts.TestFacts(cases, runs, facts.no_rows(lines, REJECTS))
