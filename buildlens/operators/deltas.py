"""Snapshots of runs and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.numbers import delta_colour, fmt_int_delta, fmt_pct_delta, pct, pct_text
from buildlens.operators.cases import test_stats
from buildlens.operators.coverage import cov_stats

SNAPSHOT_VERSION = 1
COUNTS = ["total", "passed", "failed", "skipped"]
SHARES = ["line_pct", "branch_pct", "func_pct"]


def link_runs(tests: DataFrame, coverage: DataFrame) -> DataFrame:
    """Test and coverage totals of each run side by side; either may be missing."""
    left = tests.withColumn("has_tests", F.lit(True))
    right = coverage.withColumn("has_coverage", F.lit(True))
    return left.join(right, "run_id", "full_outer").withColumns(
        {flag: F.coalesce(flag, F.lit(False)) for flag in ("has_tests", "has_coverage")}
    )


def build_snapshots(cases: DataFrame | None, files: DataFrame | None, timestamp: Column, label: Column) -> DataFrame:
    """One snapshot per run: test counts, coverage totals or both."""
    if cases is None and files is None:
        raise ValueError("a snapshot needs test cases or coverage files")
    if files is None:
        linked = test_stats(cases).withColumns({"has_tests": F.lit(True), "has_coverage": F.lit(False)})
    elif cases is None:
        linked = cov_stats(files).withColumns({"has_tests": F.lit(False), "has_coverage": F.lit(True)})
    else:
        linked = link_runs(test_stats(cases), cov_stats(files))
    return linked.select(
        "run_id",
        F.lit(SNAPSHOT_VERSION).alias("version"),
        timestamp.alias("timestamp"),
        label.alias("label"),
        *[c for c in linked.columns if c != "run_id"],
    )


def snapshot_files(files: DataFrame) -> DataFrame:
    """Line percentage per path; of repeated paths the last entry counts.

    This is the path-to-percentage map of a snapshot kept as rows, so a run
    with very many files is never gathered into one value.
    """
    last = files.groupBy("run_id", "path").agg(
        F.max_by(F.struct("lines_covered", "lines_total"), "file_ord").alias("last")
    )
    return last.select(
        "run_id", "path", pct(F.col("last.lines_covered"), F.col("last.lines_total")).alias("line_pct")
    )


def run_delta(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two sets of snapshots that share `keys`.

    A part is null, and its flag false, unless both snapshots have it.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        wanted = [c for c in (*COUNTS, *SHARES) if c in df.columns]
        return df.select(
            *keys,
            *[F.col(c).alias(prefix + c) for c in wanted],
            *[F.col(c).alias(prefix + c) for c in ("has_tests", "has_coverage")],
        )

    pairs = side(base, "b_").join(side(current, "c_"), keys, "inner")
    both_tests = F.col("b_has_tests") & F.col("c_has_tests")
    both_coverage = F.col("b_has_coverage") & F.col("c_has_coverage")

    def differences(names: list[str], both: Column) -> list[Column]:
        present = [n for n in names if "b_" + n in pairs.columns and "c_" + n in pairs.columns]
        return [
            F.when(both, F.col("c_" + n) - F.col("b_" + n)).alias(n + "_delta") for n in present
        ]

    return pairs.select(
        *keys,
        both_tests.alias("has_tests"),
        *differences(COUNTS, both_tests),
        both_coverage.alias("has_coverage"),
        *differences(SHARES, both_coverage),
    )


def file_deltas(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Change of the line percentage of paths in both snapshots, unless it is 0."""
    joined = base.select(*keys, "path", F.col("line_pct").alias("base_pct")).join(
        current.select(*keys, "path", F.col("line_pct").alias("current_pct")), [*keys, "path"], "inner"
    )
    return (
        joined.withColumn("delta", F.col("current_pct") - F.col("base_pct"))
        .where(F.col("delta") != 0)
        .select(*keys, "path", "delta")
    )


def deltas_by_path(deltas: DataFrame) -> DataFrame:
    return deltas.orderBy("path")


def cov_rows_with_delta(view: DataFrame, deltas: DataFrame, keys: list[str] = ()) -> DataFrame:
    """View rows with their change; null for new and unchanged files."""
    return view.join(deltas.select(*keys, "path", "delta"), [*keys, "path"], "left")


def with_delta_texts(deltas: DataFrame, counts: list[str], shares: list[str]) -> DataFrame:
    """Signed texts and colours of a comparison.

    Fewer passes and more failures are bad; other counts have no bad side.
    """
    out = deltas
    for name in counts:
        d = F.col(name)
        bad = (d < 0) if name == "passed_delta" else (d > 0) if name == "failed_delta" else F.lit(False)
        out = out.withColumn(name + "_text", fmt_int_delta(d)).withColumn(name + "_colour", delta_colour(d, bad))
    for name in shares:
        d = F.col(name)
        out = out.withColumn(name + "_text", fmt_pct_delta(d)).withColumn(name + "_colour", delta_colour(d))
    return out


def badge_rows(snapshots: DataFrame) -> DataFrame:
    """Label, text, colour and widths of the badges a snapshot can draw."""
    # Badge colours and the pixels taken by text and padding.
    green, yellow, red = "#4c1", "#dfb317", "#e05d44"
    per_byte, padding = 7, 24
    share = F.col("line_pct")
    coverage = F.struct(
        F.lit("coverage").alias("label"),
        pct_text(share).alias("value"),
        F.when(share >= 80, F.lit(green)).when(share >= 50, F.lit(yellow)).otherwise(F.lit(red)).alias("colour"),
    )
    bad = (F.col("failed") > 0) | (F.col("passed") < F.col("total"))
    tests = F.struct(
        F.lit("tests").alias("label"),
        F.concat_ws("/", F.col("passed").cast("string"), F.col("total").cast("string")).alias("value"),
        F.when(bad, F.lit(red)).otherwise(F.lit(green)).alias("colour"),
    )
    badges = F.array_compact(
        F.array(F.when(F.col("has_coverage"), coverage), F.when(F.col("has_tests"), tests))
    )

    def width(c: str) -> Column:
        return F.octet_length(c) * per_byte + padding

    return (
        snapshots.select("run_id", F.inline(badges))
        .withColumn("label_width", width("label"))
        .withColumn("value_width", width("value"))
    )
