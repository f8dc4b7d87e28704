"""Saved snapshots of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.operators.deltas import SNAPSHOT_VERSION
from buildlens.sources.scan import Artifacts, source_path

_SCHEMA = (
    "version INT, timestamp STRING, label STRING, "
    "tests STRUCT<total: BIGINT, passed: BIGINT, failed: BIGINT, skipped: BIGINT>, "
    "coverage STRUCT<lines_pct: DOUBLE, lines_covered: BIGINT, lines_total: BIGINT, branch_pct: DOUBLE, "
    "branch_covered: BIGINT, branch_total: BIGINT, func_pct: DOUBLE, func_covered: BIGINT, "
    "func_total: BIGINT, files: MAP<STRING, DOUBLE>>"
)


def read_snapshots(spark: SparkSession, inputs: Artifacts) -> DataFrame:
    """One row per snapshot file; a malformed or newer file fails the job."""
    raw = (
        spark.read.schema(_SCHEMA)
        .option("multiLine", "true")
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", "true")
        .json(list(inputs.paths))
        .select("*", source_path().alias("source"))
    )
    newer = F.raise_error(
        F.concat(
            F.lit("cannot read "), "source", F.lit(": saved with version "), F.col("version").cast("string"),
            F.lit(f"; versions up to {SNAPSHOT_VERSION} are known"),
        )
    ).cast("int")
    return raw.withColumn(
        "version", F.when(F.col("version") > SNAPSHOT_VERSION, newer).otherwise(F.coalesce("version", F.lit(0)))
    ).withColumn("run_id", inputs.run_of(F.col("source")))


def flat_snapshots(loaded: DataFrame) -> DataFrame:
    """Loaded snapshots in the shape of `build_snapshots`."""
    tests, coverage = F.col("tests"), F.col("coverage")
    return loaded.select(
        "run_id", "version", F.try_to_timestamp("timestamp").alias("timestamp"), "label",
        *[tests[c].alias(c) for c in ("total", "passed", "failed", "skipped")],
        *[
            coverage[c].alias(c)
            for c in (
                "lines_total", "lines_covered", "branch_total", "branch_covered", "func_total", "func_covered",
            )
        ],
        coverage["lines_pct"].alias("line_pct"),
        coverage["branch_pct"].alias("branch_pct"),
        coverage["func_pct"].alias("func_pct"),
        tests.isNotNull().alias("has_tests"),
        coverage.isNotNull().alias("has_coverage"),
    )


def loaded_files(loaded: DataFrame) -> DataFrame:
    """Path-to-percentage map of loaded snapshots as rows."""
    return loaded.select("run_id", F.explode("coverage.files").alias("path", "line_pct"))
