"""Scalar functions and format detection as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.catalog import base
from buildlens.catalog.base import query, with_tables
from buildlens.functions import numbers, text
from buildlens.functions.globs import glob_match as glob_test
from buildlens.operators import publish
from buildlens.operators.cases import attachment_rows
from buildlens.sources import gotest, lcov, registry, tap
from buildlens.sources.cucumber import scenario_rollup as roll_up_steps
from buildlens.sources.junit import normalize_suite as suite_name
from buildlens.sources.junit import parse_rfc3339 as rfc3339
from buildlens.sources.nunit import map_status as status_of
from buildlens.sources.tap import tap_fields as fields_of_line


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def choose(key: str, values: list[str], as_sql: bool = False):
    """The value at position `key` modulo the number of values."""
    if as_sql:
        quoted = ["'" + v.replace("'", "''") + "'" for v in values]
        cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted))
        return f"CASE {key} % {len(values)} {cases} END"
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


# Formats

_TEST_ARTIFACTS = [
    # (extension, head, format by the default rule, format by content)
    ("xml", "<test-run id='1'>", "junit", "nunit"),
    ("", '[{"uri": "a.feature"', "cucumber", "cucumber"),
    ("json", '{"Action":"run","Package":"p"}', "gotest", "gotest"),
    ("", "  <TestSuites>", "junit", "junit"),
    ("log", "<?xml version='1.0'?><assemblies>", "nunit", "nunit"),
    ("tap", "anything", "tap", "tap"),
    ("", " 1..4", "tap", "tap"),
    ("txt", "TAP version 13", "tap", "tap"),
    ("bin", "unknown", "-", "-"),
]
_COV_ARTIFACTS = [
    ("xml", "<report name='x'><!-- jacoco -->", "cobertura", "jacoco"),
    ("info", "x", "lcov", "lcov"),
    ("out", "x", "gocover", "gocover"),
    ("", "<coverage clover='3'>", "clover", "clover"),
    ("", "<COVERAGE line-rate='1'>", "cobertura", "cobertura"),
    ("txt", " mode: atomic", "gocover", "gocover"),
    ("", "TN:", "lcov", "lcov"),
    ("", "x\nSF:a", "lcov", "lcov"),
    ("md", "mode: other", "-", "-"),
]


def _detected(spark: SparkSession, sf_dir: str, kind: str, artifacts: list) -> DataFrame:
    heads = events(spark, sf_dir).select(
        "event_id",
        choose("event_id", [a[0] for a in artifacts]).alias("extension"),
        choose("event_id", [a[1] for a in artifacts]).alias("head"),
    )
    extension, head = F.col("extension"), F.col("head")
    return heads.select(
        "event_id",
        F.coalesce(registry.detect_format(extension, head, kind), F.lit("-")).alias("format"),
        F.coalesce(registry.detect_by_content(extension, head, kind), F.lit("-")).alias("by_content"),
    )


def _detect_sql(artifacts: list) -> str:
    return (
        f"SELECT event_id, {choose('event_id', [a[2] for a in artifacts], True)} AS format, "
        f"{choose('event_id', [a[3] for a in artifacts], True)} AS by_content FROM events"
    )


@query(_detect_sql(_TEST_ARTIFACTS))
def detect_test_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, registry.TESTS, _TEST_ARTIFACTS)


@query(_detect_sql(_COV_ARTIFACTS))
def detect_cov_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, registry.COVERAGE, _COV_ARTIFACTS)


_ALIASES = [" GTest", "ctest", "go", "JSON ", "xunit", "tap", "lcov", "coverprofile", "maven", "nope"]
_TEST_NAMES = ["junit", "junit", "gotest", "gotest", "nunit", "tap", "-", "-", "junit", "-"]
_COV_NAMES = ["-", "-", "gocover", "-", "-", "-", "lcov", "gocover", "-", "-"]


@query(
    f"SELECT event_id, {choose('event_id', _TEST_NAMES, True)} AS test_format, "
    f"{choose('event_id', _COV_NAMES, True)} AS cov_format FROM events"
)
def resolve_format_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = choose("event_id", _ALIASES)
    return events(spark, sf_dir).select(
        "event_id",
        F.coalesce(registry.resolve_format_alias(name, registry.TESTS), F.lit("-")).alias("test_format"),
        F.coalesce(registry.resolve_format_alias(name, registry.COVERAGE), F.lit("-")).alias("cov_format"),
    )


_WORDS = ["Passed", "SUCCESS", "failed", "Error", "Skipped", "pass", "Fail", ""]


@query(
    f"""SELECT event_id, {choose('event_id', ['pass', 'pass', 'fail', 'fail', 'skip', 'skip', 'skip', 'skip'], True)} AS nunit,
    {choose('event_id', ['skip', 'skip', 'skip', 'skip', 'skip', 'pass', 'fail', 'skip'], True)} AS xunit FROM events"""
)
def map_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = choose("event_id", _WORDS)
    return events(spark, sf_dir).select(
        "event_id", status_of(word, "nunit").alias("nunit"), status_of(word, "xunit").alias("xunit")
    )


# Case fields


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('com.x.T', CAST(user_id AS VARCHAR))
      WHEN 1 THEN concat('src/t', CAST(user_id AS VARCHAR), '.py')
      WHEN 2 THEN concat('test', CAST(event_id AS VARCHAR))
      ELSE concat('c/d/T', CAST(user_id AS VARCHAR), '.go') END AS suite FROM events"""
)
def normalize_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, test = F.col("user_id").cast("string"), F.concat(F.lit("test"), F.col("event_id").cast("string"))
    kind = F.col("event_id") % 4
    classname = (
        F.when(kind == 0, F.concat(F.lit(" com.x.T"), user, F.lit("."), test))
        .when(kind == 1, F.lit("PyTest"))
        .when(kind == 2, F.lit("."))
        .otherwise(F.concat(F.lit("a\\b/c/d/T"), user, F.lit(".go")))
    )
    file = F.when(kind == 1, F.concat(F.lit("src/t"), user, F.lit(".py"))).otherwise(F.lit(""))
    return events(spark, sf_dir).select("event_id", suite_name(classname, file, test).alias("suite"))


@query(
    """SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN event_id * 1500000000 ELSE 0 END AS BIGINT) AS ns FROM events"""
)
def secs_to_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("event_id") * F.lit(1.5)).cast("decimal(18,1)").cast("string")
    seconds = (
        F.when(F.col("event_id") % 3 == 0, number)
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("-"), number))
        .otherwise(F.concat(number, F.lit("s")))
    )
    return events(spark, sf_dir).select("event_id", numbers.secs_to_ns(seconds).alias("ns"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE epoch_us(date_trunc('second', ts)) // 1000000
      - CASE event_id % 3 WHEN 1 THEN 3600 ELSE 0 END END AS epoch FROM events"""
)
def parse_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = (
        F.when(F.col("event_id") % 3 == 0, stamp)
        .when(F.col("event_id") % 3 == 1, F.concat(stamp, F.lit("+01:00")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return events(spark, sf_dir).select("event_id", F.unix_timestamp(rfc3339(given)).alias("epoch"))


@query(
    """SELECT event_id, props, CASE event_id % 3 WHEN 0 THEN concat('shots/', CAST(event_id AS VARCHAR), '.PNG')
      WHEN 1 THEN concat('logs\\', CAST(event_id AS VARCHAR), '.txt') ELSE 'data:image/png;base64,AA' END AS attachment,
    CASE event_id % 3 WHEN 1 THEN 'link' ELSE 'image' END AS kind,
    CASE event_id % 3 WHEN 1 THEN concat(CAST(event_id AS VARCHAR), '.txt') END AS label FROM events"""
)
def extract_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id").cast("string")
    path = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("shots/"), number, F.lit(".PNG")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit(" logs\\"), number, F.lit(".txt")))
        .otherwise(F.lit("data:image/png;base64,AA"))
    )
    output = F.concat(F.col("props"), F.lit(" [[ATTACHMENT|"), path, F.lit("]] and [[ATTACHMENT|]] [[ATTACHMENT|open"))
    found = events(spark, sf_dir).select(
        F.col("event_id").alias("run_id"), F.lit("s").alias("suite"), F.col("props").alias("name"),
        text.extract_attachments(output).alias("attachments"),
    )
    return attachment_rows(found).select(
        F.col("run_id").alias("event_id"), F.col("name").alias("props"), "attachment", "kind", "label"
    )


attachment_kind = query(base.oracle_sql()["extract_attachments"], name="attachment_kind")(extract_attachments)


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('needs: ', props) WHEN 1 THEN 'given' ELSE '' END AS reason
    FROM events"""
)
def ctest_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    message = F.when(kind == 0, "SKIP_REGULAR_EXPRESSION_MATCHED").when(kind == 1, "given").otherwise("")
    output = F.when(
        kind < 2, F.concat(F.lit("Skipped\nno: reason\n  3 Skipped: needs: "), F.col("props"), F.lit("\n"))
    ).otherwise(F.lit("plain"))
    return events(spark, sf_dir).select("event_id", text.ctest_skip_reason(message, output).alias("reason"))


@query("SELECT event_id, concat('t.Skip(', props, ')') AS reason FROM events")
def go_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.concat(F.lit("=== RUN   T\n\n--- SKIP: T\n\tt.Skip("), F.col("props"), F.lit(")  \nmore\n"))
    return events(spark, sf_dir).select("event_id", text.go_skip_reason(output).alias("reason"))


# Documents give long texts: the message keeps 2048 bytes of what is left.
_EDGE = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+"


@query(
    f"""SELECT doc_id, octet_length(encode(body)) > 2048 AS cut,
    CASE WHEN octet_length(encode(body)) <= 2048 THEN body END AS whole FROM (
      SELECT doc_id, array_to_string(list_filter(
        [regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g') FOR x IN string_split(text, chr(10))],
        lambda x: x <> '' AND NOT starts_with(x, '--- ') AND NOT starts_with(x, '=== RUN')), chr(10)) AS body
      FROM documents)"""
)
def go_fail_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    output = F.concat(F.lit("=== RUN   T\n"), F.col("text"), F.lit("\n--- FAIL: T (0.1s)\n"))
    return documents.select("doc_id", text.go_fail_message(output).alias("message")).select(
        "doc_id",
        F.col("message").endswith("\n…").alias("cut"),
        F.when(~F.col("message").endswith("\n…"), F.col("message")).alias("whole"),
    )


@query("SELECT event_id, concat('error ', props) AS title FROM events")
def first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("  error "), F.col("props"), F.lit(" \r\nsecond\n"))
    return events(spark, sf_dir).select("event_id", text.first_line(message).alias("title"))


_RAW = "concat('50%: a,b;c]', chr(13), chr(10), {0})"


@query(
    f"""SELECT event_id,
    replace(replace(replace(replace(replace({_RAW.format('props')}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS github,
    replace(replace(replace(replace({_RAW.format('props')}, chr(13), '%0D'), chr(10), '%0A'), ']', '%5D'), ';', '%3B') AS azure
    FROM events"""
)
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("50%: a,b;c]\r\n"), F.col("props"))
    return events(spark, sf_dir).select(
        "event_id", text.esc_github(raw).alias("github"), text.esc_azure(raw).alias("azure")
    )


@query(
    """SELECT page_id, replace(replace(replace(concat('{"html":', to_json(html), '}'), '<', '\\u003c'), '>', '\\u003e'),
    '&', '\\u0026') AS json FROM pages"""
)
def html_safe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.html_safe_json(F.to_json(F.struct("html"))).alias("json"))


@query(
    """SELECT event_id, name, CASE event_id % 4 WHEN 2 THEN 'fail' WHEN 3 THEN 'skip' WHEN 0 THEN 'pass' ELSE 'skip' END AS status,
    CASE WHEN event_id % 4 = 2 THEN concat('e1 ', props, chr(10), 'e2') ELSE '' END AS message,
    CASE event_id % 4 WHEN 0 THEN 5 ELSE 15 END + event_id AS duration_ns FROM (SELECT *, event_type AS name FROM events)"""
)
def scenario_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, kind = F.col("event_id"), F.col("event_id") % 4

    def step(status, duration, error=None):
        return F.struct(
            F.struct(
                status.alias("status"), duration.cast("bigint").alias("duration"),
                (F.lit(None).cast("string") if error is None else error).alias("error_message"),
            ).alias("result")
        )

    first = step(F.lit("passed"), number)
    plain = F.array(first, step(F.lit("passed"), F.lit(5)))
    failing = F.array(
        first,
        step(F.lit("FAILED"), F.lit(5), F.concat(F.lit("e1 "), F.col("props"))),
        step(F.lit("skipped"), F.lit(4)),
        step(F.lit("failed"), F.lit(6), F.lit("e2")),
    )
    skipping = F.array(first, step(F.lit("Pending"), F.lit(15), F.lit("ignored")))
    steps = F.when(kind == 0, plain).when(kind == 2, failing).otherwise(skipping)
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("name"), steps.alias("steps"))
    rolled = roll_up_steps(F.col("steps"))
    return rows.select("event_id", "name", *[value.alias(key) for key, value in rolled.items()])


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'test' ELSE concat('name ', CAST(event_id AS VARCHAR)) END AS name,
    CASE event_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'skip' END AS status,
    CASE event_id % 4 WHEN 1 THEN concat('why ', event_type) WHEN 2 THEN 'later' END AS message,
    CAST(CASE event_id % 4 WHEN 0 THEN event_id * 250000000 ELSE 0 END AS BIGINT) AS duration_ns FROM events"""
)
def tap_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, number = F.col("event_id") % 4, F.col("event_id").cast("string")
    seconds = (F.col("event_id") * F.lit(0.25)).cast("decimal(18,2)").cast("string")
    line = (
        F.when(kind == 0, F.concat(F.lit("ok 1 - name "), number, F.lit(" # time="), seconds, F.lit(" #")))
        .when(kind == 1, F.concat(F.lit("not ok 2 name "), number, F.lit(" # why "), F.col("event_type")))
        .when(kind == 2, F.concat(F.lit("not ok 3 - name "), number, F.lit(" # skip later")))
        .otherwise(F.lit("ok 4 # SKIP"))
    )
    fields = fields_of_line(F.col("text_line"))
    return (
        events(spark, sf_dir)
        .select("event_id", line.alias("text_line"))
        .select("event_id", *[value.alias(key) for key, value in fields.items()])
    )


# Numbers and texts over file totals


@query(with_tables("file_pcts") + "SELECT run_id, path, line_pct, branch_pct, func_pct FROM file_pcts")
def pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = base.files(spark, sf_dir)
    return files.select(
        "run_id", "path",
        numbers.pct(F.col("lines_covered"), F.col("lines_total")).alias("line_pct"),
        numbers.pct(F.col("branch_covered"), F.col("branch_total")).alias("branch_pct"),
        numbers.pct(F.col("func_covered"), F.col("func_total")).alias("func_pct"),
    )


@query(with_tables("file_pcts") + "SELECT run_id, path, round(line_pct * 100.0) / 100.0 AS rounded FROM file_pcts")
def round2(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = numbers.pct(F.col("lines_covered"), F.col("lines_total"))
    return base.files(spark, sf_dir).select("run_id", "path", numbers.round2(share).alias("rounded"))


@query(
    with_tables("file_pcts")
    + """SELECT run_id, path, printf('%.1f%%', line_pct) AS text,
    CASE WHEN line_pct >= 80 THEN '🟢' WHEN line_pct >= 50 THEN '🟡' ELSE '🔴' END AS emoji FROM file_pcts"""
)
def coverage_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = numbers.pct(F.col("lines_covered"), F.col("lines_total"))
    return base.files(spark, sf_dir).select(
        "run_id", "path", numbers.pct_text(share).alias("text"), numbers.coverage_emoji(share).alias("emoji")
    )


@query(
    """SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS base,
    regexp_extract(path, '[^/]*$') AS bare_base, '' AS bare_dir FROM (SELECT concat('src/d', CAST(l_partkey % 8 AS VARCHAR),
    '/f', CAST(l_partkey AS VARCHAR), '.go') AS path FROM lineitem)"""
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = base.lines(spark, sf_dir).select("path").distinct()
    messy = F.concat(F.lit("./x//../"), F.col("path"))
    bare = text.base_name(F.concat(F.col("path"), F.lit("//")))
    return paths.select(
        "path", text.dir_of(messy).alias("dir"), text.base_name(F.col("path")).alias("base"),
        bare.alias("bare_base"), text.dir_of(bare).alias("bare_dir"),
    )


dir_of = query(base.oracle_sql()["path_parts"], name="dir_of")(path_parts)
base_name = query(base.oracle_sql()["path_parts"], name="base_name")(path_parts)


@query(
    with_tables("lines")
    + """SELECT path, regexp_matches(path, '^src/d[0-3]/f1[^/]*[.]go$') AS ranged, path LIKE 'src/d_/f__.go' AS counted,
    NOT regexp_matches(path, '^src/d[12]/') AND regexp_matches(path, '^src/d./[^/]*$') AS negated, false AS crossing
    FROM lines GROUP BY path"""
)
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = base.lines(spark, sf_dir).select("path").distinct()
    patterns = {
        "ranged": "src/d[0-3]/f1*.go", "counted": "src/d?/f??.go", "negated": "src/d[^12]/*", "crossing": "src/*.go",
    }
    return paths.select("path", *[glob_test(F.col("path"), g).alias(n) for n, g in patterns.items()])


@query(
    """SELECT p_partkey, concat('pkg', CAST(p_size AS VARCHAR), '/', replace(p_name, ' ', '_')) AS joined,
    replace(p_name, ' ', '_') AS alone FROM part"""
)
def slash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    package = F.concat(F.lit("pkg"), F.col("p_size").cast("string"), F.lit("//./"))
    return parts.select(
        "p_partkey", text.slash_join(package, name).alias("joined"), text.slash_join(F.lit(""), name).alias("alone")
    )


@query(
    """SELECT event_id, CASE WHEN ms < 1 THEN '< 1ms' WHEN ms < 1000 THEN concat(CAST(ms AS VARCHAR), 'ms')
      WHEN secs - floor(secs) IN (0.125, 0.625) THEN printf('%.2fs', secs + 0.005) ELSE printf('%.2fs', secs) END AS case_text,
    CASE WHEN ms = 0 THEN '–' WHEN ms < 60000 THEN concat(CAST(ms // 1000 AS VARCHAR), 's')
      ELSE concat(CAST(ms // 60000 AS VARCHAR), 'm ', CAST(ms // 1000 % 60 AS VARCHAR), 's') END AS run_text
    FROM (SELECT event_id, event_id * 7 AS ms, CAST(event_id * 7 AS DOUBLE) / 1000.0 AS secs FROM events)"""
)
def fmt_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("event_id") * 7
    return events(spark, sf_dir).select(
        "event_id",
        numbers.fmt_duration_ms(ms).alias("case_text"),
        numbers.fmt_run_duration(ms * F.lit(numbers.NANOS_PER_MILLI)).alias("run_text"),
    )


@query(
    """SELECT event_id, concat(CASE WHEN d > 0 THEN '+' ELSE '' END, printf('%.1f%%', d)) AS pct_text,
    concat(CASE WHEN n > 0 THEN '+' ELSE '' END, CAST(n AS VARCHAR)) AS int_text
    FROM (SELECT event_id, CAST(event_id % 81 - 40 AS DOUBLE) / 8.0 + value / 100.0 AS d, event_id % 7 - 3 AS n FROM events)"""
)
def fmt_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id")
    share = (number % 81 - 40).cast("double") / 8.0 + F.col("value") / 100.0
    return events(spark, sf_dir).select(
        "event_id", numbers.fmt_pct_delta(share).alias("pct_text"), numbers.fmt_int_delta(number % 7 - 3).alias("int_text")
    )


@query(
    with_tables("cases")
    + """SELECT run_id, CASE WHEN count(DISTINCT source) = 1 THEN min(source)
      ELSE concat(min(source), ' (+', CAST(count(DISTINCT source) - 1 AS VARCHAR), ' more)') END AS test_title,
    CASE WHEN count(DISTINCT source) = 1 THEN min(source) ELSE 'Coverage Report' END AS cov_title
    FROM (SELECT run_id, source FROM cases UNION ALL SELECT concat(run_id, '/', source), source FROM cases) GROUP BY run_id"""
)
def report_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, and every one of its inputs as a run of its own."""
    runs = base.cases(spark, sf_dir).select("run_id", "source")
    single = runs.select(F.concat_ws("/", "run_id", "source").alias("run_id"), "source")
    inputs = runs.unionByName(single).groupBy("run_id").agg(
        F.min("source").alias("first"), F.count_distinct("source").alias("n")
    )
    given = F.lit("")
    return inputs.select(
        "run_id",
        publish.report_title(given, F.col("first"), F.col("n")).alias("test_title"),
        publish.cov_report_title(given, F.col("first"), F.col("n")).alias("cov_title"),
    )


# Line state, on lines that Spark derives from the table


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of three sources in event order."""
    place = F.struct(F.lit(0).cast("bigint").alias("block_start"), F.col("event_id").alias("row_id"))
    source = F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))
    return events(spark, sf_dir).select(
        "*", F.lit("r").alias("run_id"), source.alias("source"), source.alias("source_ord"), place.alias("seq")
    )


@query(
    """SELECT source, event_id FROM (SELECT event_id, concat('s', CAST(event_id % 3 AS VARCHAR)) AS source, event_type,
      last_value(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 0 END IGNORE NULLS) OVER (PARTITION BY event_id % 3
        ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM events)
    WHERE event_type NOT IN ('error', 'signup') AND coalesce(inside, 0) = 0"""
)
def tap_yaml_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (
        F.when(F.col("event_type") == "error", "  --- #").when(F.col("event_type") == "signup", " ...").otherwise("ok 1")
    )
    kept = tap.tap_yaml_mask(event_lines(spark, sf_dir).withColumn("value", value), chunk_bits=8)
    return kept.select("source", "event_id")


_ACTION = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'run' WHEN 'purchase' THEN 'pass' ELSE 'output' END"


@query(
    f"""WITH e AS (SELECT event_id, concat('s', CAST(event_id % 3 AS VARCHAR)) AS source, user_id % 5 AS t, props, {_ACTION} AS action
      FROM events),
    b AS (SELECT *, CASE WHEN action <> 'output' THEN action END AS mark,
      CASE WHEN action <> 'output' THEN event_id END AS mark_id FROM e),
    w AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY source, t ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
      first_value(mark IGNORE NULLS) OVER (PARTITION BY source, t ORDER BY event_id
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed,
      first_value(mark_id IGNORE NULLS) OVER (PARTITION BY source, t ORDER BY event_id
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed_id FROM b)
    SELECT source, concat('t', CAST(t AS VARCHAR)) AS test, closed_id AS event_id, string_agg(props, '' ORDER BY event_id) AS raw_output
    FROM w WHERE action = 'output' AND opened = 'run' AND closed IN ('fail', 'skip') GROUP BY source, t, closed_id"""
)
def gotest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_lines(spark, sf_dir).select(
        "run_id", "source", "source_ord", "seq", F.lit("p").alias("package"),
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("test"),
        F.expr(_ACTION).alias("action"), F.lit(0.0).alias("elapsed"), F.col("props").alias("output"),
    )
    segments = gotest.gotest_segments(rows, chunk_bits=8)
    return segments.select("source", "test", F.col("seq.row_id").alias("event_id"), "raw_output")


@query(
    """SELECT event_id, n AS pos, concat('src/', event_type, CAST(n AS VARCHAR), '.c') AS path,
    CASE n WHEN 0 THEN concat('DA:1,', CAST(event_id AS VARCHAR)) ELSE 'BRDA:1,0,0,-|DA:2,0' END AS details
    FROM events, (SELECT 0 AS n UNION ALL SELECT 1) r"""
)
def lcov_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(
        F.lit("DA:7,7\nTN:\n SF :src/"), "event_type", F.lit("0.c\n# note\nDA:1,"), F.col("event_id").cast("string"),
        F.lit("\n end_of_record\nDA:9,9\nSF:src/"), "event_type", F.lit("1.c\n  BRDA:1,0,0,-\n\nDA:2,0\n"),
    )
    records = lcov.lcov_records(event_lines(spark, sf_dir).select("run_id", "source", "source_ord", "seq", value.alias("value")))
    return records.select(
        F.col("file_ord.row_id").alias("event_id"), F.col("file_ord.pos")[0].alias("pos"), "path",
        F.array_join("details", "|").alias("details"),
    )
