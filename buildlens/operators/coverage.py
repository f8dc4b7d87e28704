"""Operators over coverage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.globs import excluded
from buildlens.functions.numbers import GOOD_PCT, WARN_PCT, coverage_band, pct, round2
from buildlens.functions.numbers import band_colour, treemap_colour
from buildlens.functions.text import dir_of
from buildlens.functions.text import strip_prefix as strip_prefix_column
from buildlens.operators.cases import every_run, sort_key
from buildlens.plans.paging import Key, page, page_of_each, sort_columns

TOTALS = [
    "lines_total", "lines_covered", "branch_total", "branch_covered", "func_total", "func_covered",
]
PCTS = {"line_pct": ("lines_covered", "lines_total"), "branch_pct": ("branch_covered", "branch_total"),
        "func_pct": ("func_covered", "func_total")}
RUN = ["run_id"]

# Page lengths of the views.
PAGE_FILES = 200
PAGE_DIRS = 50


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Drop a leading directory from the paths that start with it."""
    return df.withColumn("path", strip_prefix_column(F.col("path"), prefix))


def exclude_paths(df: DataFrame, globs: list[str]) -> DataFrame:
    """Rows whose path no pattern covers."""
    return df.where(~excluded(F.col("path"), globs))


# Aggregates


def cov_file_totals(
    entries: DataFrame,
    lines: DataFrame,
    branches: DataFrame | None,
    funcs: DataFrame | None,
    keys: list[str],
) -> DataFrame:
    """Six totals per file entry; unreachable branches do not count.

    The tables become one narrow stream of 0/1 columns, so there is a single
    shuffle after map-side sums and no join. Entries without details keep their
    row, and repeated lines count repeatedly. A caller that needs line figures
    only leaves the other tables out, and they are not read.
    """

    def counted(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select(
            *keys, *[columns.get(t, F.lit(False)).cast("bigint").alias(t) for t in TOTALS]
        )

    always = F.lit(True)
    stream = counted(entries).unionByName(
        counted(lines, lines_total=always, lines_covered=F.col("hits") > 0)
    )
    if branches is not None:
        reachable = branches.where(F.col("taken") >= 0)
        stream = stream.unionByName(
            counted(reachable, branch_total=always, branch_covered=F.col("taken") > 0)
        )
    if funcs is not None:
        stream = stream.unionByName(counted(funcs, func_total=always, func_covered=F.col("calls") > 0))
    return stream.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in TOTALS])


def sum_totals(files: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return files.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in TOTALS], *more)


def with_pcts(df: DataFrame) -> DataFrame:
    """Add the three percentages of the totals."""
    return df.select("*", *[pct(F.col(c), F.col(t)).alias(name) for name, (c, t) in PCTS.items()])


def cov_stats(files: DataFrame, keys: list[str] = RUN, runs: DataFrame | None = None) -> DataFrame:
    """Totals and weighted percentages per run.

    With `runs` (the run rows of the inputs) a run without any file has a row of zeros.
    """
    sums = sum_totals(files, keys, F.count(F.lit(1)).alias("file_count"))
    return with_pcts(sums if runs is None else every_run(runs, sums, keys))


def cov_view_rows(files: DataFrame) -> DataFrame:
    """Rows of the coverage table: directory, percentages to two places, counts."""
    rows = with_pcts(files)
    return rows.select(
        "run_id", "path",
        dir_of(F.col("path")).alias("dir"),
        *[round2(F.col(p)).alias(p) for p in PCTS],
        *TOTALS,
    )


def dir_rollup(view: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Totals, percentages and files below the threshold per directory."""
    folder = F.when(F.col("dir") == "", F.lit("(root)")).otherwise(F.col("dir"))
    rolled = sum_totals(
        view.withColumn("dir", folder),
        ["run_id", "dir"],
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(below_threshold(threshold)).alias("below_count"),
    )
    return with_pcts(rolled).orderBy("run_id", "dir")


def below_threshold_count(view: DataFrame, threshold: float) -> DataFrame:
    """Files below the threshold per run; files without lines count too."""
    return view.groupBy(*RUN).agg(F.count_if(below_threshold(threshold)).alias("below_count"))


# Predicates and columns over view rows


def below_threshold(threshold: float) -> Column:
    return F.col("line_pct") < F.lit(float(threshold))


def with_bands(view: DataFrame) -> DataFrame:
    """Badge band and the two colour scales."""
    share = F.col("line_pct")
    return view.select(
        "*",
        coverage_band(share).alias("band"),
        band_colour(share).alias("bar_colour"),
        treemap_colour(share).alias("treemap_colour"),
    )


def filter_coverage_band(view: DataFrame, band: str) -> DataFrame:
    """Files of a band: all, zero, low or warn."""
    share, total = F.col("line_pct"), F.col("lines_total")
    tests = {
        "all": F.lit(True),
        "zero": (total > 0) & (share <= 0),
        "low": (share < WARN_PCT) & (share != 0),
        "warn": (share >= WARN_PCT) & (share < GOOD_PCT),
    }
    return view.where(tests[band])


def search_files(view: DataFrame, query: str) -> DataFrame:
    """Files whose path or directory contains the query, ignoring case."""
    wanted = query.lower().strip()
    if not wanted:
        return view
    return view.where(F.lower("path").contains(wanted) | F.lower("dir").contains(wanted))


# Orders


def worst_files(files: DataFrame, threshold: float) -> DataFrame:
    """Files with lines below the threshold, lowest first."""
    low = with_pcts(files).where((F.col("lines_total") > 0) & below_threshold(threshold))
    return low.orderBy("run_id", "line_pct", "path")


def files_by_path(files: DataFrame) -> DataFrame:
    return files.orderBy("run_id", "path")


def files_by_size(view: DataFrame) -> DataFrame:
    """Files with lines, largest first."""
    return view.where(F.col("lines_total") > 0).orderBy("run_id", F.col("lines_total").desc(), "path")


def file_sort_keys(column: str, descending: bool = False) -> list[Key]:
    return [sort_key(column, descending), (F.col("run_id"), False), (F.col("path"), False)]


def sort_files(view: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return view.orderBy(*sort_columns(file_sort_keys(column, descending)))


def page_files(
    view: DataFrame, number: int, size: int = PAGE_FILES, column: str = "path", descending: bool = False
) -> DataFrame:
    """One page of the files of all runs together."""
    return page(view, file_sort_keys(column, descending), number, size)


def page_files_of_runs(
    view: DataFrame, number: int, size: int = PAGE_FILES, column: str = "path", descending: bool = False
) -> DataFrame:
    """One page of the files of each run; past the end of a run it is its last page."""
    return page_of_each(view, ["run_id"], file_sort_keys(column, descending), number, size)


def page_dirs(view: DataFrame, number: int, size: int = PAGE_DIRS) -> DataFrame:
    return page(dir_rollup(view), [(F.col("run_id"), False), (F.col("dir"), False)], number, size)


def page_dirs_of_runs(view: DataFrame, number: int, size: int = PAGE_DIRS) -> DataFrame:
    """One page of the directories of each run."""
    return page_of_each(dir_rollup(view), ["run_id"], [(F.col("dir"), False)], number, size)
