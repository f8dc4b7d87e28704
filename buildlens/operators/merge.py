"""Merging the inputs of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.operators.cases import test_stats
from buildlens.operators.coverage import TOTALS
from buildlens.plans.rank import ranked
from buildlens.plans.skew import attach
from buildlens.session import materialize


def merge_test_runs(runs: DataFrame) -> DataFrame:
    """One row per run: longest duration, first input and number of inputs.

    Cases need no work: grouping by run and suite merges suites of one name,
    and repeats across inputs are kept. The inputs themselves stay rows of
    `runs`; `first_source` and `source_count` give the report title.
    """
    return runs.groupBy("run_id").agg(
        F.max("duration_ns").alias("duration_ns"),
        F.min_by("source", "source_ord").alias("first_source"),
        F.count(F.lit(1)).alias("source_count"),
    )


def merged_suites(cases: DataFrame) -> DataFrame:
    """Suites of all inputs of a run merged by name: where each comes among them, and what it holds.

    The merged suites of a run go by the first input and place that names them; `place` counts
    from 1 in each run. A suite is first added up per input, so a name in very many inputs is no hot group.
    """
    case = F.struct("source_ord", "seq")
    by_input = cases.groupBy("run_id", "suite", "source_ord").agg(
        F.min(case).alias("first_seen"), F.count(F.lit(1)).alias("tests"), F.count_if(F.col("status") == "fail").alias("failures")
    )
    merged = by_input.groupBy("run_id", "suite").agg(
        F.min("first_seen").alias("first_seen"), F.count(F.lit(1)).alias("sources"),
        F.sum("tests").alias("tests"), F.sum("failures").alias("failures"),
    )
    placed = materialize(ranked(merged, [F.asc("run_id"), F.asc("first_seen")], "_at", "suites"), "merged-suites")
    before = placed.groupBy("run_id").agg((F.min("_at") - 1).alias("_before"))
    return attach(placed, before, ["run_id"]).withColumn("place", F.col("_at") - F.col("_before")).drop("_at", "_before")


def merged_sources(runs: DataFrame) -> DataFrame:
    """Inputs of each run in merge order."""
    return runs.select("run_id", "source_ord", "source").orderBy("run_id", "source_ord")


def separate_runs(cases: DataFrame) -> DataFrame:
    """Totals with one report per input instead of one per run."""
    return test_stats(cases, ["run_id", "source"])


def merge_cov_runs(files: DataFrame) -> DataFrame:
    """File entries of a run after merging its inputs.

    Entries of the first input all stay. A later entry adds to the last
    first-input entry of its path; entries of a path new to the run share one
    row. Merging appends raw rows, so totals simply add up, and the work is on
    per-entry totals. Every step is an aggregate that combines map-side. The
    totals are stored once, because they are read three times.
    """
    files = materialize(files, "entry-totals")
    first_source = files.groupBy("run_id").agg(F.min("source_ord").alias("_first"))
    tagged = attach(files, first_source, ["run_id"]).withColumn(
        "_is_first", F.col("source_ord") == F.col("_first")
    )
    first = tagged.where("_is_first").select(
        "run_id", "path", F.lit(True).alias("from_first"), "file_ord", *TOTALS
    )
    by_path = tagged.groupBy("run_id", "path").agg(
        F.max(F.when(F.col("_is_first"), F.col("file_ord"))).alias("file_ord"),
        F.min(F.when(~F.col("_is_first"), F.struct("source_ord", "file_ord"))).alias("_later"),
        *[F.sum(F.when(~F.col("_is_first"), F.col(t))).alias(t) for t in TOTALS],
    )
    added = by_path.where(F.col("_later").isNotNull()).select(
        "run_id", "path",
        F.col("file_ord").isNotNull().alias("from_first"),
        F.coalesce("file_ord", "_later.file_ord").alias("file_ord"),
        *TOTALS,
    )
    merged = first.unionByName(added).groupBy("run_id", "path", "from_first", "file_ord")
    return merged.agg(*[F.sum(t).alias(t) for t in TOTALS])
