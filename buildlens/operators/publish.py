"""Published texts: JSON, SARIF, Markdown, annotations, webhook bodies.

A document is a set of rows (run_id, ord, text): the texts of a run in the
order of `ord` are the document. No document is ever gathered into one value,
so its size has no limit; `write_documents` writes it in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import TOOL_NAME
from buildlens.functions.numbers import coverage_emoji, pct, pct_text
from buildlens.functions.text import blank_to_null, esc_azure, esc_github, first_line, html_safe_json
from buildlens.operators.cases import case_order, duration_ms, failed_only, first_seen_suites, test_stats
from buildlens.operators.coverage import cov_stats, with_pcts
from buildlens.plans.skew import attach
from buildlens.session import materialize

RUN = ["run_id"]
PLATFORMS = ("github", "gitlab", "azure")

# The schema of the SARIF format and its version.
SARIF_SCHEMA = "https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"


def write_documents(rows: DataFrame, path: str, whole_files: bool = False) -> None:
    """Write document rows as text below `run_id=…` folders.

    By default a document is cut into part files that follow each other by
    name, so one huge document is written by many tasks. With `whole_files` it
    is a single file, for readers that need that; rows stream through a sort.
    """
    placed = rows.repartition("run_id") if whole_files else rows.repartitionByRange("run_id", "ord")
    (
        placed.sortWithinPartitions("run_id", "ord")
        .select("run_id", "text")
        .write.partitionBy("run_id")
        .text(path)
    )


def _document(head: DataFrame, items: DataFrame, foot: Column) -> DataFrame:
    """Rows of `head`, then the items by their `place`, then `foot` once per run.

    `head` has run_id and text; `items` have run_id, place and text.
    """
    kind = items.schema["place"].dataType

    def at(section: int, place: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), place.cast(kind).alias("place")).alias("ord")

    return (
        head.select("run_id", at(0, F.lit(None)), "text")
        .unionByName(items.select("run_id", at(1, F.col("place")), "text"))
        .unionByName(head.select("run_id", at(2, F.lit(None)), foot.alias("text")))
    )


def _separated(items: DataFrame) -> DataFrame:
    """Put a comma before every item but the first of its run."""
    first = items.groupBy(*RUN).agg(F.min("place").alias("_first"))
    comma = F.when(F.col("place") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    return attach(items, first, RUN).withColumn("text", F.concat(comma, "text")).drop("_first")


def _without_last(json: Column, count: int) -> Column:
    return F.substr(json, F.lit(1), F.length(json) - count)


def in_suite_order(cases: DataFrame) -> DataFrame:
    """Add `place` and `run_first`, the place of the first case of the run.

    Suites go by first appearance, and cases by their own place.
    """
    suites = materialize(first_seen_suites(cases), "suites")
    runs = suites.groupBy(*RUN).agg(F.min("first_seen").alias("run_first"))
    order = F.struct(F.col("first_seen").alias("suite"), case_order(cases).alias("case"))
    known = attach(suites, runs, RUN)
    return attach(cases, known, ["run_id", "suite"]).withColumn("place", order).drop("first_seen")


def _in_failure_order(cases: DataFrame, failed: DataFrame) -> DataFrame:
    """Add `place` to failures; their suites are ordered among all cases."""
    order = F.struct(F.col("first_seen").alias("suite"), case_order(cases).alias("case"))
    return attach(failed, first_seen_suites(cases), ["run_id", "suite"]).withColumn("place", order)


# JSON reports


def test_summary(cases: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    return test_stats(cases, runs=runs).withColumn("pass_pct", pct(F.col("passed"), F.col("total")))


test_summary.__test__ = False


def case_json(cases: DataFrame) -> Column:
    """One case; absent fields are left out."""
    return F.to_json(
        F.struct(
            "name", "status",
            duration_ms(cases).alias("duration_ms"),
            blank_to_null(F.col("message")).alias("message"),
            blank_to_null(F.col("file")).alias("file"),
            F.when(F.col("line") != 0, F.col("line")).alias("line"),
        )
    )


# What stands in a JSON report in place of an empty list.
_NO_ITEMS = "null}"


def _open_list(count: str) -> Column:
    return F.when(F.col(count) > 0, F.lit("[")).otherwise(F.lit(_NO_ITEMS))


def _list_foot(foot: str) -> Column:
    """The end of a document, unless its head has no list to close."""
    return F.when(F.endswith("text", F.lit(_NO_ITEMS)), F.lit("")).otherwise(F.lit(foot))


def test_report_json(cases: DataFrame, generated_at: str, runs: DataFrame | None = None) -> DataFrame:
    """Document rows of the JSON test report, one row per case; with `runs`, empty runs have one too."""
    placed = in_suite_order(cases)
    opens_suite = F.col("place.suite") == F.col("place.case")
    opens_run = F.col("place.case") == F.col("run_first")
    suite_open = F.concat(
        F.when(opens_run, F.lit("")).otherwise(F.lit("]},")),
        _without_last(F.to_json(F.struct(F.col("suite").alias("name"))), 1),
        F.lit(',"cases":['),
    )
    text = F.concat(F.when(opens_suite, suite_open).otherwise(F.lit(",")), case_json(placed))
    summary = F.struct("total", "passed", "failed", "skipped", "pass_pct")
    head = F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), summary.alias("summary")))
    return _document(
        test_summary(cases, runs).select(
            "run_id", F.concat(_without_last(head, 1), F.lit(',"suites":'), _open_list("total")).alias("text")
        ),
        placed.select("run_id", "place", text.alias("text")),
        _list_foot("]}]}"),
    )


test_report_json.__test__ = False


def file_place(files: DataFrame) -> Column:
    """Order of a file entry in its run."""
    return F.struct(*[c for c in ("source_ord", "file_ord", "path") if c in files.columns])


def _pct_fields(omit_empty: bool) -> list[Column]:
    fields = []
    for kind in ("branch", "func"):
        total = F.col(f"{kind}_total")
        for column, name in ((f"{kind}_pct",) * 2, (f"{kind}_covered",) * 2, (f"{kind}_total",) * 2):
            shown = F.when(total > 0, F.col(column)) if omit_empty else F.col(column)
            # A zero is left out too, as an absent field.
            fields.append((F.when(shown != 0, shown) if omit_empty else shown).alias(name))
    return fields


def cov_file_json(files: DataFrame) -> DataFrame:
    """(run_id, place, text): one JSON object per file entry."""
    rows = with_pcts(files)
    line = [F.col("line_pct").alias("lines_pct"), F.col("lines_covered"), F.col("lines_total")]
    text = F.to_json(F.struct("path", *line, *_pct_fields(omit_empty=True)))
    return rows.select("run_id", file_place(rows).alias("place"), text.alias("text"))


def cov_report_json(files: DataFrame, generated_at: str, runs: DataFrame | None = None) -> DataFrame:
    """Document rows of the JSON coverage report, one row per file; with `runs`, empty runs have one too."""
    summary = F.struct(
        F.col("line_pct").alias("lines_pct"), "lines_covered", "lines_total",
        *_pct_fields(omit_empty=False), "file_count",
    )
    head = F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), summary.alias("summary")))
    return _document(
        cov_stats(files, runs=runs).select(
            "run_id", F.concat(_without_last(head, 1), F.lit(',"files":'), _open_list("file_count")).alias("text")
        ),
        _separated(cov_file_json(files)),
        _list_foot("]}"),
    )


# SARIF


def _location(uri: Column, line: Column) -> Column:
    place = F.struct(
        F.struct(uri.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
        F.when(line > 0, F.struct(line.alias("startLine"))).alias("region"),
    )
    return F.when(uri.isNotNull(), F.array(F.struct(place.alias("physicalLocation"))))


def _sarif_result(rule: str, level: str, text: Column, locations: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit(rule).alias("ruleId"),
            F.lit(level).alias("level"),
            F.struct(text.alias("text")).alias("message"),
            locations.alias("locations"),
        )
    )


def test_sarif_results(cases: DataFrame) -> DataFrame:
    """(run_id, place, text): one error per failed case."""
    failed = failed_only(cases)
    message = blank_to_null(F.col("message"))
    text = F.when(message.isNull(), F.col("name")).otherwise(F.concat("name", F.lit(": "), message))
    result = _sarif_result(
        "test-failure", "error", text, _location(blank_to_null(F.col("file")), F.col("line"))
    )
    return _in_failure_order(cases, failed).select("run_id", "place", result.alias("text"))


test_sarif_results.__test__ = False


def cov_sarif_results(files: DataFrame, threshold: float) -> DataFrame:
    """(run_id, place, text): one warning per file below the threshold.

    Files without lines are below any threshold; threshold 0 gives no rows.
    """
    rows = with_pcts(files)
    low = rows.where(F.lit(threshold > 0) & (F.col("line_pct") < F.lit(float(threshold))))
    text = F.concat(
        "path", F.lit(": line coverage "), pct_text(F.col("line_pct")),
        F.lit(f" is below the threshold of {threshold:.1f}%."),
    )
    result = _sarif_result(
        "coverage-below-threshold", "warning", text,
        _location(blank_to_null(F.col("path")), F.lit(0)),
    )
    return low.select("run_id", file_place(rows).alias("place"), result.alias("text"))


def test_sarif_rule() -> dict[str, str]:
    return {
        "id": "test-failure",
        "short": "Test case failed",
        "full": "A test case reported a failure or error.",
        "level": "error",
    }


test_sarif_rule.__test__ = False


def cov_sarif_rule(threshold: float) -> dict[str, str]:
    return {
        "id": "coverage-below-threshold",
        "short": "File coverage below threshold",
        "full": f"The file's line coverage is below the minimum threshold of {threshold:.1f}%.",
        "level": "warning",
    }


def sarif_document(
    runs: DataFrame, results: DataFrame, rule: dict[str, str], version: str, information_uri: str
) -> DataFrame:
    """Document rows that wrap results; a run without results has an empty array."""

    def text(value: str) -> Column:
        return F.struct(F.lit(value).alias("text"))

    rule_object = F.struct(
        F.lit(rule["id"]).alias("id"),
        text(rule["short"]).alias("shortDescription"),
        text(rule["full"]).alias("fullDescription"),
        F.struct(F.lit(rule["level"]).alias("level")).alias("defaultConfiguration"),
        F.lit(information_uri).alias("helpUri"),
    )
    driver = F.struct(
        F.lit(TOOL_NAME).alias("name"),
        F.lit(version).alias("version"),
        F.lit(information_uri).alias("informationUri"),
        F.array(rule_object).alias("rules"),
    )
    run = _without_last(F.to_json(F.struct(F.struct(driver.alias("driver")).alias("tool"))), 1)
    envelope = F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version")))
    head = F.concat(_without_last(envelope, 1), F.lit(',"runs":['), run, F.lit(',"results":['))
    return _document(runs.select("run_id", head.alias("text")), _separated(results), F.lit("]}]}"))


# Annotations


def _check_platform(platform: str) -> None:
    if platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}: must be one of {', '.join(PLATFORMS)}")


def _red(label: str) -> Column:
    return F.lit(f"\x1b[31m{label}\x1b[0m  ")


def test_annotations(cases: DataFrame, platform: str) -> DataFrame:
    """One CI log line per failed case, suites by first appearance and cases by their place."""
    _check_platform(platform)
    failed = _in_failure_order(cases, failed_only(cases))
    title = first_line(F.coalesce(blank_to_null(F.col("message")), F.lit("test failed")))
    file = F.coalesce(blank_to_null(F.col("file")), F.replace("suite", F.lit("."), F.lit("/")))
    name, line = F.col("name"), F.col("line")
    has_line = F.coalesce(line > 0, F.lit(False))
    if platform == "github":
        place = F.concat(F.lit("file="), esc_github(file), F.lit(",line="), line.cast("string"), F.lit(","))
        text = F.concat(
            F.lit("::error "), F.when(has_line, place).otherwise(F.lit("")),
            F.lit("title="), esc_github(name), F.lit("::"), esc_github(title),
        )
    elif platform == "gitlab":
        text = F.concat(_red("FAIL"), "suite", F.lit(" :: "), name, F.lit(" — "), title)
    else:
        number = F.concat(F.lit("linenumber="), line.cast("string"), F.lit(";"))
        text = F.concat(
            F.lit("##vso[task.logissue type=error;sourcepath="), esc_azure(file), F.lit(";"),
            F.when(has_line, number).otherwise(F.lit("")),
            F.lit("title="), esc_azure(name), F.lit("]"), esc_azure(title),
        )
    return failed.select("run_id", "place", "suite", "seq", text.alias("text")).orderBy("run_id", "place")


test_annotations.__test__ = False


def cov_annotations(files: DataFrame, threshold: float, platform: str) -> DataFrame:
    """One warning per low file, worst first, and one error per low run."""
    _check_platform(platform)
    limit = f"{threshold:.1f}%"
    enabled = F.lit(threshold > 0)
    bound = F.lit(float(threshold))
    path, share = F.col("path"), F.col("line_pct")
    detail = F.concat(
        pct_text(share), F.lit(" line coverage ("), F.col("lines_covered").cast("string"), F.lit("/"),
        F.col("lines_total").cast("string"), F.lit(f" lines) — threshold {limit}"),
    )
    summary = F.concat(F.lit("overall line coverage "), pct_text(share), F.lit(f" is below threshold {limit}"))
    if platform == "github":
        warning = F.concat(
            F.lit("::warning file="), esc_github(path), F.lit(",title=Low Coverage::"), esc_github(detail)
        )
        error = F.concat(F.lit("::error title=Coverage Below Threshold::"), esc_github(summary))
    elif platform == "gitlab":
        warning = F.concat(F.lit("\x1b[33mWARN\x1b[0m  "), path, F.lit(" — "), detail)
        error = F.concat(_red("FAIL"), summary)
    else:
        warning = F.concat(
            F.lit("##vso[task.logissue type=warning;sourcepath="), esc_azure(path), F.lit("]"), esc_azure(detail)
        )
        error = F.concat(F.lit("##vso[task.logissue type=error]"), esc_azure(summary))

    low = with_pcts(files).where(enabled & (F.col("lines_total") > 0) & (share < bound))
    overall = cov_stats(files).where(enabled & (share < bound))
    return (
        low.select("run_id", F.lit(0).alias("kind"), "line_pct", "path", warning.alias("text"))
        .unionByName(
            overall.select(
                "run_id", F.lit(1).alias("kind"), "line_pct",
                F.lit(None).cast("string").alias("path"), error.alias("text"),
            )
        )
        .orderBy("run_id", "kind", "line_pct", "path")
    )


# Markdown


def _table_rows(rows: list[Column]) -> Column:
    """Array of (place, text) without the absent rows."""
    numbered = [
        F.when(text.isNotNull(), F.struct(F.lit(i).alias("place"), text.alias("text")))
        for i, text in enumerate(rows)
    ]
    return F.array_compact(F.array(*numbered))


def test_markdown_rows(
    cases: DataFrame, generated_at: str, title: str = "Test Report", runs: DataFrame | None = None
) -> DataFrame:
    """Document rows of the Markdown test summary: metrics, then failures; with `runs`, empty runs have one too."""

    def metric(label: str, value: str) -> Column:
        return F.concat(F.lit(f"| {label} | "), F.col(value).cast("string"), F.lit(" |"))

    lines = [
        F.lit(f"## {title}\n"),
        F.lit(f"_Generated: {generated_at}_\n"),
        F.lit("| Metric | Value |\n|--------|-------|"),
        metric("**Total**", "total"),
        metric("✅ Passed", "passed"),
        metric("❌ Failed", "failed"),
        metric("⏭️ Skipped", "skipped"),
        F.concat(F.lit("| Pass rate | "), pct_text(F.col("pass_pct")), F.lit(" |\n")),
        F.when(F.col("failed") > 0, F.lit("### ❌ Failed Tests\n")),
    ]
    head = test_summary(cases, runs).select("run_id", F.inline(_table_rows(lines)))

    failed = _in_failure_order(cases, failed_only(cases))
    message, stdout = blank_to_null(F.col("message")), blank_to_null(F.col("stdout"))
    section = F.concat(
        F.lit("#### `"), "suite", F.lit(" / "), "name", F.lit("`\n"),
        F.coalesce(F.concat(F.lit("\n```\n"), message, F.lit("\n```\n")), F.lit("")),
        F.coalesce(
            F.concat(
                F.lit("\n<details><summary>Output</summary>\n\n```\n"), stdout, F.lit("\n```\n\n</details>\n")
            ),
            F.lit(""),
        ),
    )
    body = failed.select("run_id", "place", section.alias("text"))
    return _sections(head, body)


test_markdown_rows.__test__ = False


def _sections(*parts: DataFrame) -> DataFrame:
    """Union of (run_id, place, text) parts, each after the one before."""
    kinds = [part.schema["place"].dataType for part in parts]

    def place(part: int) -> Column:
        columns = [
            (F.col("place") if i == part else F.lit(None)).cast(kind).alias(f"place{i}")
            for i, kind in enumerate(kinds)
        ]
        return F.struct(F.lit(part).alias("section"), *columns).alias("ord")

    rows = [part.select("run_id", place(i), "text") for i, part in enumerate(parts)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def cov_markdown_rows(files: DataFrame, generated_at: str, runs: DataFrame | None = None) -> DataFrame:
    """Document rows of the Markdown coverage summary: metrics, then files; with `runs`, empty runs have one too."""

    def metric(label: str, kind: str, total: str) -> Column:
        share = F.col(f"{kind}_pct")
        return F.concat(
            F.lit("| "), coverage_emoji(share), F.lit(f" {label} | "),
            F.col(total.replace("_total", "_covered")).cast("string"), F.lit(" | "),
            F.col(total).cast("string"), F.lit(" | "), pct_text(share), F.lit(" |"),
        )

    def optional(text: Column, total: str) -> Column:
        return F.when(F.col(total) > 0, text)

    table = [
        F.lit("## Coverage Report\n"),
        F.lit(f"_Generated: {generated_at}_\n"),
        F.lit("| Metric | Covered | Total | % |\n|--------|---------|-------|----|"),
        metric("Lines", "line", "lines_total"),
        optional(metric("Branches", "branch", "branch_total"), "branch_total"),
        optional(metric("Functions", "func", "func_total"), "func_total"),
        F.lit(""),
        F.concat(
            F.lit("<details><summary>Per-file coverage ("), F.col("file_count").cast("string"),
            F.lit(" files)</summary>\n"),
        ),
        F.lit(
            "| File | Lines % | Lines | Branches % | Functions % |\n"
            "|------|---------|-------|------------|-------------|"
        ),
    ]
    stats = cov_stats(files, runs=runs)
    head = stats.select("run_id", F.inline(_table_rows(table)))

    def share_or_dash(kind: str) -> Column:
        return F.when(F.col(f"{kind}_total") > 0, pct_text(F.col(f"{kind}_pct"))).otherwise(F.lit("–"))

    rows = with_pcts(files)
    row = F.concat(
        F.lit("| `"), "path", F.lit("` | "), pct_text(F.col("line_pct")), F.lit(" | "),
        F.col("lines_covered").cast("string"), F.lit("/"), F.col("lines_total").cast("string"), F.lit(" | "),
        share_or_dash("branch"), F.lit(" | "), share_or_dash("func"), F.lit(" |"),
    )
    body = rows.select("run_id", file_place(rows).alias("place"), row.alias("text"))
    foot = stats.select("run_id", F.lit(0).alias("place"), F.lit("\n</details>\n").alias("text"))
    return _sections(head, body, foot)


# Snapshots and webhook bodies


def snapshot_documents(snapshots: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Document rows of snapshot JSON; the files of a run are one row each."""

    def part(flag: str, *columns: Column) -> Column:
        if flag not in snapshots.columns or any(c not in snapshots.columns for c in _NEEDED[flag]):
            return F.lit(None).cast("string")
        return F.when(F.col(flag), F.to_json(F.struct(*columns)))

    tests = part("has_tests", *[F.col(c) for c in _NEEDED["has_tests"]])
    coverage = part(
        "has_coverage",
        F.col("line_pct").alias("lines_pct"),
        *[F.col(c) for c in _NEEDED["has_coverage"][1:]],
    )
    base = F.to_json(
        F.struct(
            "version",
            F.date_format(
                F.to_utc_timestamp("timestamp", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"
            ).alias("timestamp"),
            blank_to_null(F.col("label")).alias("label"),
        )
    )
    with_tests = F.concat(_without_last(base, 1), F.coalesce(F.concat(F.lit(',"tests":'), tests), F.lit("")))
    opened = F.concat(F.lit(',"coverage":'), _without_last(coverage, 1))
    if files is None:
        whole = F.concat(with_tests, F.coalesce(F.concat(opened, F.lit("}")), F.lit("")), F.lit("}"))
        items = snapshots.limit(0).select("run_id", F.lit("").alias("place"), F.lit("").alias("text"))
        return _document(snapshots.select("run_id", whole.alias("text")), items, F.lit(""))

    head = F.concat(with_tests, F.coalesce(F.concat(opened, F.lit(',"files":{')), F.lit("")))
    entry = F.concat(
        F.regexp_extract(F.to_json(F.struct("path")), r'(?s)^\{"path":(.*)\}$', 1),
        F.lit(":"), F.col("line_pct").cast("string"),
    )
    items = _separated(files.select("run_id", F.col("path").alias("place"), entry.alias("text")))
    # The footer closes what the head of the same run has opened.
    foot = F.when(F.endswith("text", F.lit('"files":{')), F.lit("}}}")).otherwise(F.lit("}"))
    return _document(snapshots.select("run_id", head.alias("text")), items, foot)


_NEEDED = {
    "has_tests": ["total", "passed", "failed", "skipped"],
    "has_coverage": [
        "line_pct", "lines_covered", "lines_total", "branch_pct", "branch_covered", "branch_total",
        "func_pct", "func_covered", "func_total",
    ],
}


def write_snapshots(snapshots: DataFrame, files: DataFrame | None, path: str) -> None:
    """One JSON file per run, as `read_snapshots` takes it."""
    write_documents(snapshot_documents(snapshots, files), path, whole_files=True)


def notify_payload_rows(snapshots: DataFrame, timestamp: str) -> DataFrame:
    """Webhook bodies of the test and coverage parts of each snapshot."""
    stamp = [F.lit(TOOL_NAME).alias("tool"), F.lit(timestamp).alias("timestamp")]

    def non_zero(column: str) -> Column:
        return F.when(F.col(column) != 0, F.col(column)).alias(column)

    tests = F.to_json(
        F.struct(
            *stamp, "total", "passed", "failed", "skipped",
            pct(F.col("passed"), F.col("total")).alias("pass_pct"),
        )
    )
    coverage = F.to_json(
        F.struct(
            *stamp, F.col("line_pct").alias("lines_pct"), "lines_covered", "lines_total",
            non_zero("branch_pct"), non_zero("func_pct"), "file_count",
        )
    )
    bodies = F.array_compact(
        F.array(
            F.when(F.col("has_tests"), F.struct(F.lit("tests").alias("kind"), tests.alias("body"))),
            F.when(F.col("has_coverage"), F.struct(F.lit("coverage").alias("kind"), coverage.alias("body"))),
        )
    )
    return snapshots.select("run_id", F.inline(bodies))


# Page data


def report_title(title: Column, first_source: Column, source_count: Column) -> Column:
    """Title of a test report: given, else its input, else the first of many."""
    more = F.concat(first_source, F.lit(" (+"), (source_count - 1).cast("string"), F.lit(" more)"))
    fallback = (
        F.when(source_count == 0, F.lit("Test Report")).when(source_count == 1, first_source).otherwise(more)
    )
    return F.coalesce(blank_to_null(title), fallback)


def cov_report_title(title: Column, first_source: Column, source_count: Column) -> Column:
    fallback = F.when(source_count == 1, first_source).otherwise(F.lit("Coverage Report"))
    return F.coalesce(blank_to_null(title), fallback)


def view_json(view: DataFrame) -> DataFrame:
    """Each row of a view as JSON that is safe inside a page."""
    fields = [c for c in view.columns if c != "run_id"]
    text = html_safe_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    return view.select("run_id", text.alias("text"))
