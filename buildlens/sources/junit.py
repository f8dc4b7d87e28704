"""JUnit XML and its Google Test superset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import parse_float, parse_int, secs_to_ns, seconds_to_nanos
from buildlens.functions.text import blank_to_null, ctest_skip_reason, extract_attachments, trim_space
from buildlens.operators.cases import collapse_retries
from buildlens.schemas import record_seq
from buildlens.session import materialize
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, chosen, scan_documents, source_path
from buildlens.sources.xmltext import (
    XML_OPTIONS,
    parsed_documents,
    start_tags,
    tag_attribute,
    text_or_empty,
)

_MESSAGE = "STRUCT<_message: STRING, _VALUE: STRING>"
_TESTCASE = (
    "_name STRING, _classname STRING, _time STRING, _file STRING, _line STRING, "
    f"failure {_MESSAGE}, error {_MESSAGE}, skipped {_MESSAGE}, `system-out` STRING"
)

# Suite names that say nothing, and extensions that are not a test name.
GENERIC_SUITES = ("", ".", "alltests", "test suite", "pytest")
SOURCE_EXTENSIONS = ("cpp", "c", "cc", "cxx", "py", "go", "java", "js", "ts")


def normalize_suite(classname: Column, file: Column, name: Column) -> Column:
    """Suite of a case: class name, else file, else test name, tidied."""
    given = trim_space(classname)
    given = F.when(F.lower(given).isin(*GENERIC_SUITES), F.lit("")).otherwise(given)
    base = F.coalesce(blank_to_null(given), blank_to_null(file), name)

    head = F.regexp_extract(base, r"(?s)^(.+)\.([^.]+)$", 1)
    tail = F.regexp_extract(base, r"(?s)^(.+)\.([^.]+)$", 2)
    embeds_test = (tail != "") & (tail == name) & ~head.contains("/")
    base = F.when(embeds_test & ~F.lower(tail).isin(*SOURCE_EXTENSIONS), head).otherwise(base)

    slashed = F.replace(base, F.lit("\\"), F.lit("/"))
    parts = F.split(slashed, "/")
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, -3, 3), "/")).otherwise(slashed)


def parse_rfc3339(c: Column) -> Column:
    """RFC 3339 time, or the same without a zone taken as UTC; null otherwise."""
    shape = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?"
    zone = r"(Z|[+-]\d\d:\d\d)$"
    zoned = F.when(c.rlike(zone), c).otherwise(F.concat(c, F.lit("Z")))
    return F.when(c.rlike(rf"{shape}({zone}|$)"), zoned.try_cast("timestamp"))


def _content(message: Column) -> Column:
    """Message attribute, else the element text."""
    attribute = trim_space(text_or_empty(message["_message"]))
    return F.when(attribute != "", attribute).otherwise(trim_space(text_or_empty(message["_VALUE"])))


def junit_cases(rows: DataFrame) -> DataFrame:
    """Cases of parsed <testcase> elements."""
    failure, error, skipped = F.col("failure"), F.col("error"), F.col("skipped")
    name, file = text_or_empty(F.col("_name")), text_or_empty(F.col("_file"))
    stdout = trim_space(text_or_empty(F.col("system-out")))
    failed = failure.isNotNull() | error.isNotNull()
    attachments = extract_attachments(stdout)
    message = (
        F.when(failure.isNotNull(), _content(failure))
        .when(error.isNotNull(), _content(error))
        .when(skipped.isNotNull(), ctest_skip_reason(_content(skipped), stdout))
    )
    return facts.test_cases(
        rows,
        suite=normalize_suite(text_or_empty(F.col("_classname")), file, name),
        seq=record_seq(F.col("seq")),
        name=name,
        status=F.when(failed, "fail").when(skipped.isNotNull(), "skip").otherwise("pass"),
        duration_ns=secs_to_ns(F.col("_time")),
        message=blank_to_null(message),
        stdout=F.when(failed, blank_to_null(stdout)),
        file=blank_to_null(file),
        line=parse_int(F.col("_line")),
        attachments=F.when(F.size(attachments) > 0, attachments),
    )


def junit_runs(docs: DataFrame) -> DataFrame:
    """Run time (first non-zero `time`) and timestamp (last valid one) per input."""
    tags = start_tags(F.col("value"), "testsuites|testsuite")
    times = F.transform(tags, lambda t: seconds_to_nanos(parse_float(tag_attribute(t, "time"))))
    stamps = F.transform(tags, lambda t: parse_rfc3339(tag_attribute(t, "timestamp")))
    return facts.test_runs(
        docs,
        duration_ns=F.coalesce(F.get(F.filter(times, lambda t: t != 0), F.lit(0)), F.lit(0)),
        ts=F.try_element_at(F.filter(stamps, lambda t: t.isNotNull()), F.lit(-1)),
    )


def ingest_junit(spark: SparkSession, inputs: Artifacts, collapse: bool = True) -> facts.TestFacts:
    """Read <testcase> elements at any depth; retries of one test are collapsed.

    The row reader streams and accepts a file with a broken tail, so a second
    pass over the documents finds the malformed ones and drops their rows.
    """
    elements = (
        spark.read.format("xml")
        .options(**XML_OPTIONS)
        .option("rowTag", "testcase")
        .option("recursiveFileLookup", "true")
        .schema(_TESTCASE)
        .load(list(inputs.paths))
        .select(
            "*",
            source_path().alias("source"),
            F.struct(
                F.lit(0).cast("bigint").alias("block_start"),
                F.monotonically_increasing_id().alias("row_id"),
            ).alias("seq"),
        )
        .withColumn("run_id", inputs.run_of(F.col("source")))
        .withColumn("source_ord", F.col("source"))
    )
    elements = chosen(elements, inputs)
    checked = parsed_documents(scan_documents(spark, inputs), "_time STRING")
    broken = F.col("broken") & (trim_space(F.col("value")) != "")
    rejected = materialize(facts.rejects(checked.where(broken), "junit", "malformed XML"), "rejects")
    cases = facts.without_rejected(materialize(junit_cases(elements), "junit"), rejected)
    runs = junit_runs(checked.where(~broken))
    return facts.TestFacts(collapse_retries(cases) if collapse else cases, runs, rejected)
