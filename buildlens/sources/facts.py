"""What an ingestion job yields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.text import strip_prefix
from buildlens.plans.skew import attach
from buildlens.schemas import COV_RECORDS, ENTRY_KEYS, REJECTS, TEST_CASES, TEST_RUNS, conform


@dataclass(frozen=True)
class TestFacts:
    """Cases, one run row per input, and the inputs that could not be read."""

    __test__ = False

    cases: DataFrame
    runs: DataFrame
    rejects: DataFrame

    def union(self, other: TestFacts) -> TestFacts:
        return TestFacts(
            self.cases.unionByName(other.cases),
            self.runs.unionByName(other.runs),
            self.rejects.unionByName(other.rejects),
        )


@dataclass(frozen=True)
class CoverageFacts:
    """File entries, their three kinds of detail rows, inputs and rejects."""

    entries: DataFrame
    lines: DataFrame
    branches: DataFrame
    funcs: DataFrame
    runs: DataFrame
    rejects: DataFrame

    def union(self, other: CoverageFacts) -> CoverageFacts:
        return CoverageFacts(
            *(getattr(self, f).unionByName(getattr(other, f)) for f in CoverageFacts.__dataclass_fields__)
        )

    def with_prefix_stripped(self, prefix: str) -> CoverageFacts:
        def strip(df: DataFrame) -> DataFrame:
            return df.withColumn("path", strip_prefix(F.col("path"), prefix))

        return CoverageFacts(
            strip(self.entries), strip(self.lines), strip(self.branches), strip(self.funcs),
            self.runs, self.rejects,
        )


def id_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in ("run_id", "source", "source_ord")}


def test_cases(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*conform(TEST_CASES, **id_columns(), **values))


def test_runs(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*conform(TEST_RUNS, **id_columns(), **values))


def timed_runs(sources: DataFrame, durations: DataFrame) -> DataFrame:
    """A run row per input; inputs without a duration have 0."""
    nanos = F.greatest(F.coalesce("total", F.lit(0)), F.lit(0))
    return test_runs(sources.join(durations, "source", "left"), duration_ns=nanos)


def rejects(df: DataFrame, fmt: str, error: str) -> DataFrame:
    return df.select(
        *conform(REJECTS, run_id=F.col("run_id"), source=F.col("source"), format=F.lit(fmt), error=F.lit(error))
    )


def no_rows(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    return df.sparkSession.createDataFrame([], ", ".join(f"`{k}` {v}" for k, v in schema.items()))


def without_rejected(df: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of the inputs that were read in full."""
    return attach(df, rejected.select("source").distinct(), ["source"], how="left_anti")


def coverage_facts(records: DataFrame, runs: DataFrame, rejected: DataFrame) -> CoverageFacts:
    """Flat tables of nested per-entry records."""

    def detail(kind: str) -> DataFrame:
        return records.select(*ENTRY_KEYS, F.inline(kind))

    return CoverageFacts(
        records.select(*ENTRY_KEYS), detail("lines"), detail("branches"), detail("funcs"), runs, rejected
    )


def cov_records(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*conform(COV_RECORDS, **id_columns(), **values))


def line_struct(line: Column, hits: Column) -> Column:
    return F.struct(line.alias("line"), hits.alias("hits"))


def func_struct(name: Column, line: Column, calls: Column) -> Column:
    return F.struct(name.alias("name"), line.alias("line"), calls.alias("calls"))
