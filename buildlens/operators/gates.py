"""Quality gates as result columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.numbers import round2
from buildlens.operators.deltas import link_runs


def check_threshold(name: str, value: float) -> float:
    if not 0 <= value <= 100:
        raise ValueError(f"threshold {name} is {value:g}; a percentage from 0 to 100 is needed")
    return float(value)


def coverage_gate(stats: DataFrame, line: float = 0, branch: float = 0, func: float = 0) -> DataFrame:
    """One row per run and metric; the unrounded percentage must reach the threshold.

    A threshold of 0 turns its metric off.
    """
    metrics = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(column).alias("actual_pct"),
            F.lit(check_threshold(name, value)).alias("threshold"),
        )
        for name, column, value in (
            ("line", "line_pct", line), ("branch", "branch_pct", branch), ("func", "func_pct", func),
        )
    ]
    rows = stats.select("run_id", F.inline(F.array(*metrics)))
    return rows.withColumn(
        "failed", (F.col("threshold") > 0) & (F.col("actual_pct") < F.col("threshold"))
    )


def test_gate(stats: DataFrame) -> DataFrame:
    """A run fails when any test failed."""
    return stats.select("run_id", F.col("failed").alias("failed_tests"), (F.col("failed") > 0).alias("gate_failed"))


test_gate.__test__ = False


def combined_gate(tests: DataFrame, coverage: DataFrame, threshold: float = 0) -> DataFrame:
    """Test and line coverage gates of the runs that have both.

    With threshold 0 coverage fails only when no line at all is covered.
    """
    check_threshold("threshold", threshold)
    linked = link_runs(tests, coverage).where("has_tests AND has_coverage")
    if threshold > 0:
        coverage_failed = F.col("line_pct") < F.lit(float(threshold))
    else:
        coverage_failed = (F.col("lines_covered") == 0) & (F.col("lines_total") > 0)
    return linked.select(
        "run_id",
        (F.col("failed") > 0).alias("tests_failed"),
        coverage_failed.alias("coverage_failed"),
    ).withColumn("gate_failed", F.col("tests_failed") | F.col("coverage_failed"))


def test_run_status() -> Column:
    return F.when(F.col("failed") > 0, "FAILED").otherwise("PASSED")


test_run_status.__test__ = False


def coverage_run_status(threshold: float) -> Column:
    """Page status, which compares the percentage rounded to two places."""
    low = (F.lit(threshold) > 0) & (round2(F.col("line_pct")) < F.lit(float(threshold)))
    return F.when(low, "BELOW THRESHOLD").otherwise("PASS")


def run_status(tests: DataFrame, coverage: DataFrame, threshold: float = 0) -> DataFrame:
    """Status texts of each run; null for a part the run does not have."""
    check_threshold("threshold", threshold)
    return link_runs(tests, coverage).select(
        "run_id",
        F.when(F.col("has_tests"), test_run_status()).alias("test_status"),
        F.when(F.col("has_coverage"), coverage_run_status(threshold)).alias("coverage_status"),
    )
