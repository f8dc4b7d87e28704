"""Operators over test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.numbers import fixed, fmt_duration_ms, nanos_to_millis, pct
from buildlens.plans.paging import Key, page, page_of_each, sort_columns
from buildlens.plans.skew import attach
from buildlens.schemas import STATUSES

RUN = ["run_id"]
RETRY_KEYS = ["run_id", "source", "suite", "name"]

# A test is slow from this share of the longest one, and never
# below the floor; page lengths of the views.
SLOW_SHARE = 0.1
SLOW_FLOOR_MS = 100.0
PAGE_TESTS = 200
PAGE_SUITES = 50


def case_order(df: DataFrame) -> Column:
    """Order of a case within its run: by input, then by place in the input."""
    if "source_ord" in df.columns:
        return F.struct("source_ord", "seq")
    return F.struct("seq")


def duration_ms(df: DataFrame) -> Column:
    return nanos_to_millis(F.col("duration_ns"))


# Aggregates


def passed() -> Column:
    """A flaky test passed in the end."""
    return F.count_if(F.col("status").isin("pass", "flaky"))


def test_stats(cases: DataFrame, keys: list[str] = RUN, runs: DataFrame | None = None) -> DataFrame:
    """total, passed, failed and skipped per group.

    With `runs` (the run rows of the inputs) a run without any case has a row of zeros.
    """
    stats = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        passed().alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
    )
    return stats if runs is None else every_run(runs, stats, keys)


def every_run(runs: DataFrame, summary: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """The summary rows, and rows of zeros for the runs without one."""
    return runs.select(*keys).distinct().join(summary, keys, "left").na.fill(0)


test_stats.__test__ = False


def flaky_count(cases: DataFrame, keys: list[str] = RUN) -> DataFrame:
    return cases.groupBy(*keys).agg(F.count_if(F.col("status") == "flaky").alias("flaky"))


def with_status_pcts(stats: DataFrame) -> DataFrame:
    """Add pass, fail and skip percentages to test_stats."""
    total = F.col("total")
    return stats.select(
        "*",
        pct(F.col("passed"), total).alias("pass_pct"),
        pct(F.col("failed"), total).alias("fail_pct"),
        pct(F.col("skipped"), total).alias("skip_pct"),
    )


def run_duration(fmt: str, time: Column, order: Column) -> Column:
    """Aggregate for the duration of one input of a format.

    JUnit takes the first non-zero time, go test the longest one, TAP their
    sum; other formats carry none.
    """
    if fmt == "junit":
        value = F.min_by(time, F.when(time != 0, order))
    elif fmt == "gotest":
        value = F.max(time)
    elif fmt == "tap":
        value = F.sum(time)
    else:
        value = F.max(F.lit(0))
    return F.coalesce(value, F.lit(0)).cast("bigint")


def suite_rollup(cases: DataFrame) -> DataFrame:
    """Tests and failures per suite, by suite name."""
    return (
        cases.groupBy("run_id", "suite")
        .agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("status") == "fail").alias("failures"))
        .withColumn("all_pass", F.col("failures") == 0)
        .orderBy("run_id", "suite")
    )


def first_seen_suites(cases: DataFrame) -> DataFrame:
    """Distinct suites with the place of their first case."""
    return cases.groupBy("run_id", "suite").agg(F.min(case_order(cases)).alias("first_seen"))


def collapse_retries(cases: DataFrame) -> DataFrame:
    """One row per test of an input.

    Repeats with a failure and a pass become the last pass marked `flaky`; any
    other repeats become their first row. The first place is kept. Aggregates
    combine before the shuffle, so a test repeated very often is no hot group.
    """
    rest = [c for c in cases.columns if c not in RETRY_KEYS]
    row = F.struct(*rest)
    is_pass = F.col("status") == "pass"
    grouped = cases.groupBy(*RETRY_KEYS).agg(
        F.min_by(row, "seq").alias("first_row"),
        F.max_by(row, F.when(is_pass, F.col("seq"))).alias("last_pass"),
        F.max(F.col("status") == "fail").alias("has_fail"),
    )
    flaky = F.col("has_fail") & F.col("last_pass").isNotNull()
    chosen = F.when(
        flaky,
        F.col("last_pass").withField("status", F.lit("flaky")).withField("seq", F.col("first_row.seq")),
    ).otherwise(F.col("first_row"))
    return grouped.select(*RETRY_KEYS, chosen.alias("row")).select(*RETRY_KEYS, "row.*").select(*cases.columns)


# Filters


def filter_status(cases: DataFrame, status: str) -> DataFrame:
    """Cases of one status, or of all."""
    if status == "all":
        return cases
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return cases.where(F.col("status") == status)


def failed_only(cases: DataFrame) -> DataFrame:
    return cases.where(F.col("status") == "fail")


def search_cases(cases: DataFrame, query: str) -> DataFrame:
    """Cases whose suite or name contains the query, ignoring case."""
    wanted = query.lower().strip()
    if not wanted:
        return cases
    return cases.where(F.lower("suite").contains(wanted) | F.lower("name").contains(wanted))


# Views


def mark_slow(view: DataFrame) -> DataFrame:
    """Flag cases near the longest one of their run, among the rows given."""
    longest = view.groupBy(*RUN).agg(F.max(duration_ms(view)).alias("max_ms"))
    limit = F.greatest(F.col("max_ms") * F.lit(SLOW_SHARE), F.lit(SLOW_FLOOR_MS))
    return attach(view, longest, RUN).withColumn("slow", duration_ms(view) >= limit).drop("max_ms")


def timeline_pct(cases: DataFrame) -> DataFrame:
    """Bar length of every timed case, relative to the longest of its run."""
    timed = cases.withColumn("duration_ms", duration_ms(cases)).where(F.col("duration_ms") > 0)
    longest = timed.groupBy(*RUN).agg(F.max("duration_ms").alias("max_ms"))
    share = F.col("duration_ms").cast("double") / F.col("max_ms").cast("double") * F.lit(100.0)
    return (
        attach(timed, longest, RUN)
        .withColumn("bar_pct", fixed(share, 1, ties="up"))
        .withColumn("duration_text", fmt_duration_ms(F.col("duration_ms")))
        .drop("max_ms")
        .orderBy("run_id", "suite", case_order(timed))
    )


def test_view_rows(cases: DataFrame) -> DataFrame:
    """Rows of the test table; only failures show their output."""
    return cases.select(
        "run_id", "suite", "name", "status",
        duration_ms(cases).alias("duration_ms"),
        "message",
        F.when(F.col("status") == "fail", F.col("stdout")).alias("stdout"),
        "file", "line", "attachments",
    )


test_view_rows.__test__ = False


def attachment_kind(attachment: Column) -> Column:
    """image or link."""
    is_image = attachment.rlike(r"(?i)\.(png|jpe?g|gif|webp)$") | attachment.startswith("data:image/")
    return F.when(is_image, F.lit("image")).otherwise(F.lit("link"))


def attachment_rows(cases: DataFrame) -> DataFrame:
    """One row per attachment with its kind and the label of a link."""
    flat = cases.select("run_id", "suite", "name", F.explode("attachments").alias("attachment"))
    tail = F.substring_index(F.substring_index("attachment", "/", -1), "\\", -1)
    return flat.withColumn("kind", attachment_kind(F.col("attachment"))).withColumn(
        "label",
        F.when(F.col("kind") == "link", F.when(tail == "", F.lit("attachment")).otherwise(tail)),
    )


TEXT_COLUMNS = ("suite", "name", "status", "message", "path", "dir")


def sort_key(column: str, descending: bool = False) -> Key:
    """Locale order for text, numeric order for the rest."""
    key = F.collate(F.coalesce(column, F.lit("")), "UNICODE") if column in TEXT_COLUMNS else F.col(column)
    return key, descending


def case_sort_keys(cases: DataFrame, column: str, descending: bool = False) -> list[Key]:
    """Chosen column first; equal rows keep their place in the run."""
    return [sort_key(column, descending), (F.col("run_id"), False), (case_order(cases), False)]


def sort_cases(cases: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return cases.orderBy(*sort_columns(case_sort_keys(cases, column, descending)))


def page_cases(
    cases: DataFrame, number: int, size: int = PAGE_TESTS, column: str = "suite", descending: bool = False
) -> DataFrame:
    """One page of the flat view of all runs together."""
    return page(cases, case_sort_keys(cases, column, descending), number, size)


def page_cases_of_runs(
    cases: DataFrame, number: int, size: int = PAGE_TESTS, column: str = "suite", descending: bool = False
) -> DataFrame:
    """One page of the flat view of each run; past the end of a run it is its last page."""
    return page_of_each(cases, RUN, case_sort_keys(cases, column, descending), number, size)


def page_suites(cases: DataFrame, number: int, size: int = PAGE_SUITES) -> DataFrame:
    """One page of the grouped view: suite headers by name."""
    return page(suite_rollup(cases), [(F.col("run_id"), False), (F.col("suite"), False)], number, size)


def page_suites_of_runs(cases: DataFrame, number: int, size: int = PAGE_SUITES) -> DataFrame:
    """One page of the suite headers of each run."""
    return page_of_each(suite_rollup(cases), RUN, [(F.col("suite"), False)], number, size)
