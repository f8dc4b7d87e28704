"""Ingestion as queries: render the tables to artifacts, read them back, compare.

The SQL side works on the table itself, so it knows nothing of the parsers.
Test documents hold at most DOC_CASES cases, which their unique event number
guarantees; coverage lines are written as a sorted stream that is never
gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.catalog import base
from buildlens.catalog.base import query, with_tables
from buildlens.catalog.deltas import SNAPSHOT_SQL, snapshots
from buildlens.functions.numbers import nanos_to_millis
from buildlens.operators import coverage as cov
from buildlens.operators import deltas as delta_ops
from buildlens.operators import publish
from buildlens.schemas import ENTRY_KEYS
from buildlens.session import scratch_path
from buildlens.sources import registry
from buildlens.sources.clover import ingest_clover
from buildlens.sources.cobertura import ingest_cobertura
from buildlens.sources.cucumber import ingest_cucumber
from buildlens.sources.facts import CoverageFacts, TestFacts
from buildlens.sources.gocover import ingest_gocover
from buildlens.sources.gotest import ingest_gotest
from buildlens.sources.jacoco import ingest_jacoco
from buildlens.sources.junit import ingest_junit
from buildlens.sources.lcov import ingest_lcov
from buildlens.sources.nunit import ingest_nunit2, ingest_nunit3, ingest_xunit
from buildlens.sources.owners import read_owner_rules as read_rules
from buildlens.sources.scan import Artifacts, artifacts, scan_artifacts
from buildlens.sources.snapshots import flat_snapshots, loaded_files, read_snapshots
from buildlens.sources.tap import ingest_tap

DOC_CASES = 1000
DOC_LINES = 20_000
_RUNS = 4  # event numbers of one run are this far apart


def located(path: str) -> Artifacts:
    """Files below `run=…` folders."""
    return artifacts(path, run_id=F.regexp_extract(F.col("source"), r"run=([^/]+)", 1))


def doc_number() -> Column:
    return F.floor(F.col("seq") / (DOC_CASES * _RUNS)).cast("int")


def document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with the document they are written to and their time in seconds."""
    df = base.cases(spark, sf_dir)
    milliseconds = nanos_to_millis(F.col("duration_ns"))
    return df.withColumns(
        {
            "doc": doc_number(),
            "ms": milliseconds,
            "secs": (milliseconds / F.lit(1000)).cast("decimal(18,3)").cast("string"),
        }
    )


def write_case_documents(rows: DataFrame, item: Column, head: str, foot: str, label: str, order=None) -> str:
    """Write one file per (run, document): head, the items in order, foot."""
    path = scratch_path(rows.sparkSession, label)
    keyed = F.struct(*(order or [F.col("seq")]), item.alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["text"])
    documents = rows.groupBy(F.col("run_id").alias("run"), "doc").agg(
        F.concat(F.lit(head), F.array_join(texts, "\n"), F.lit(foot)).alias("text")
    )
    documents.write.partitionBy("run", "doc").text(path)
    return path


def ingested(facts: TestFacts) -> DataFrame:
    """Cases as rows to compare, with the number of their document."""
    return facts.cases.select(
        "run_id",
        F.regexp_extract("source", r"doc=(\d+)", 1).cast("int").alias("doc"),
        "suite", "name", "status",
        nanos_to_millis(F.col("duration_ns")).alias("duration_ms"),
        "message", "file", "line",
    )


def xml_text(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def attribute(name: str, value: Column) -> Column:
    """` name="value"`, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), xml_text(value.cast("string")), F.lit('"')), F.lit(""))


def tag(name: str, attributes: dict[str, Column], content: Column | None = None) -> Column:
    opening = F.concat(F.lit(f"<{name}"), *[attribute(k, v) for k, v in attributes.items()])
    if content is None:
        return F.concat(opening, F.lit("/>"))
    return F.concat(opening, F.lit(">"), content, F.lit(f"</{name}>"))


_DOC = f"CAST(seq // {DOC_CASES * _RUNS} AS INT)"
_DOC_CASES = f"SELECT *, {_DOC} AS doc FROM cases"
# Formats that hold seconds lose a millisecond where seconds * 10**9 falls short.
SECONDS_MS = "CAST(trunc(CAST(duration_ms AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(1000000000 AS DOUBLE)) AS BIGINT) // 1000000"
_TIMED_CASES = f"SELECT * REPLACE ({SECONDS_MS} AS duration_ms), {_DOC} AS doc FROM cases"
_PLAIN = "run_id, doc, suite, name, status, duration_ms"
_NO_PLACE = "CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INT) AS line"


@query(
    with_tables(
        "cases",
        doc_cases=_TIMED_CASES,
        doc_retries="""SELECT run_id, doc, suite, name, min(seq) AS first_seq,
            max(seq) FILTER (WHERE status = 'pass') AS pass_seq, bool_or(status = 'fail') AS has_fail
            FROM doc_cases GROUP BY ALL""",
    )
    + """SELECT c.run_id, c.doc, c.suite, c.name,
      CASE WHEN r.has_fail AND r.pass_seq IS NOT NULL THEN 'flaky' ELSE c.status END AS status,
      c.duration_ms, c.message, c.file, c.line
    FROM doc_retries r JOIN doc_cases c
      ON c.seq = CASE WHEN r.has_fail AND r.pass_seq IS NOT NULL THEN r.pass_seq ELSE r.first_seq END"""
)
def junit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = (
        F.when(F.col("status") == "fail", tag("failure", {"message": F.col("message")}))
        .when(F.col("status") == "skip", F.lit("<skipped/>"))
        .otherwise(F.lit(""))
    )
    case = tag(
        "testcase",
        {"name": F.col("name"), "classname": F.col("suite"), "time": F.col("secs"),
         "file": F.col("file"), "line": F.col("line")},
        result,
    )
    path = write_case_documents(
        document_cases(spark, sf_dir), case, "<testsuites><testsuite>\n", "\n</testsuite></testsuites>", "junit"
    )
    return ingested(ingest_junit(spark, located(path)))


# Events of two tests at a time are interleaved.
@query(
    with_tables("cases", doc_cases=_TIMED_CASES)
    + f"""SELECT {_PLAIN}, CASE status WHEN 'fail' THEN concat('got ', message) WHEN 'skip' THEN 'later' END AS message, {_NO_PLACE}
    FROM doc_cases"""
)
def gotest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def event(action: str, **more: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit(action).alias("Action"), F.col("suite").alias("Package"), F.col("name").alias("Test"),
                *[value.alias(key) for key, value in more.items()],
            )
        )

    noise = F.concat(F.lit("=== RUN   "), F.col("name"), F.lit("\n"))
    said = F.when(F.col("status") == "fail", F.concat(F.lit("  got "), F.col("message"), F.lit("\n"))).otherwise(
        F.lit("later\n")
    )
    end = F.to_json(
        F.struct(
            F.col("status").alias("Action"), F.col("suite").alias("Package"), F.col("name").alias("Test"),
            (F.col("ms") / 1000.0).alias("Elapsed"),
        )
    )
    steps = F.array(event("run"), event("output", Output=noise), event("output", Output=said), end)
    rows = document_cases(spark, sf_dir).select(
        "run_id", "doc", "seq", F.floor(F.col("seq") / 8).alias("pair"), F.posexplode(steps).alias("step", "event")
    )
    path = write_case_documents(rows, F.col("event"), "", "\n", "gotest", [F.col(c) for c in ("pair", "step", "seq")])
    return ingested(ingest_gotest(spark, located(path)))


@query(
    with_tables("cases", doc_cases=_TIMED_CASES)
    + f"""SELECT run_id, doc, 'tap' AS suite, concat(suite, ' ', name) AS name, status, duration_ms,
    CASE status WHEN 'fail' THEN message WHEN 'skip' THEN 'later' END AS message, {_NO_PLACE} FROM doc_cases"""
)
def tap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit(" - "), "suite", F.lit(" "), "name", F.lit(" # time="), "secs")
    line = (
        F.when(F.col("status") == "pass", F.concat(F.lit("ok 1"), label))
        .when(F.col("status") == "skip", F.concat(F.lit("ok 2"), label, F.lit(" # SKIP later")))
        .otherwise(
            F.concat(F.lit("not ok 3"), label, F.lit(" # "), "message", F.lit("\n  ---\nnot ok 4 - hidden\n  ..."))
        )
    )
    path = write_case_documents(document_cases(spark, sf_dir), line, "TAP version 13\n", "\n", "tap")
    return ingested(ingest_tap(spark, located(path))).withColumn("suite", F.lit("tap"))


def _result_word(words: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in words.items() for x in pair]
    return F.create_map(*pairs)[F.col("status")]


def _failure() -> Column:
    content = F.concat(F.lit("<message>"), xml_text(F.col("message")), F.lit("</message><stack-trace>at x</stack-trace>"))
    return F.when(F.col("status") == "fail", tag("failure", {}, content)).otherwise(F.lit(""))


def _nunit_documents(spark: SparkSession, sf_dir: str, root: str, levels: int = 2) -> str:
    words = {"pass": "Passed", "fail": "Failed", "skip": "Skipped"}
    reason = F.when(F.col("status") == "skip", F.lit("<reason><message>later</message></reason>")).otherwise(F.lit(""))
    case = tag(
        "test-case",
        {"name": F.col("name"), "result": _result_word(words), "duration": F.col("secs")},
        F.concat(_failure(), reason),
    )
    outer = levels - 1
    suite = F.concat(
        F.lit('<test-suite name="outer">' * outer), tag("test-suite", {"name": F.col("suite")}, case), F.lit("</test-suite>" * outer)
    )
    return write_case_documents(document_cases(spark, sf_dir), suite, f"<{root}>\n", f"\n</{root}>", root)


_NUNIT_SQL = (
    with_tables("cases", doc_cases=_TIMED_CASES)
    + f"""SELECT {_PLAIN}, CASE status WHEN 'fail' THEN concat(message, chr(10), 'at x') WHEN 'skip' THEN 'later' END AS message,
    {_NO_PLACE} FROM doc_cases"""
)


@query(_NUNIT_SQL)
def nunit3_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(ingest_nunit3(spark, located(_nunit_documents(spark, sf_dir, "test-run"))))


@query(_NUNIT_SQL)
def nunit_deep_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case lies twelve suites deep."""
    return ingested(ingest_nunit3(spark, located(_nunit_documents(spark, sf_dir, "test-run", levels=12))))


@query(_NUNIT_SQL)
def nunit2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(ingest_nunit2(spark, located(_nunit_documents(spark, sf_dir, "test-results"))))


@query(
    with_tables("cases", doc_cases=_TIMED_CASES)
    + f"""SELECT {_PLAIN}, CASE status WHEN 'fail' THEN concat(message, chr(10), 'at x') END AS message, {_NO_PLACE} FROM doc_cases"""
)
def xunit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"pass": "Pass", "fail": "Fail", "skip": "Skip"}
    test = tag("test", {"name": F.col("name"), "result": _result_word(words), "time": F.col("secs")}, _failure())
    path = write_case_documents(
        document_cases(spark, sf_dir), tag("collection", {"name": F.col("suite")}, test),
        '<assemblies><assembly name="a">\n', "\n</assembly></assemblies>", "xunit",
    )
    return ingested(ingest_xunit(spark, located(path)))


@query(
    with_tables("cases", doc_cases=_DOC_CASES)
    + f"""SELECT {_PLAIN}, CASE status WHEN 'fail' THEN concat(message, chr(10), 'again') END AS message, {_NO_PLACE} FROM doc_cases"""
)
def cucumber_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(status: Column | str, duration: Column, error: Column | None = None) -> Column:
        result = [F.lit(status).alias("status"), duration.alias("duration")]
        if error is not None:
            result.append(error.alias("error_message"))
        return F.to_json(F.struct(F.struct(*result).alias("result")))

    zero, is_fail = F.lit(0).cast("bigint"), F.col("status") == "fail"
    steps = F.array_compact(
        F.array(
            step("passed", F.col("duration_ns")),
            F.when(is_fail, step("failed", zero, F.col("message"))),
            F.when(is_fail, step("Failed", zero, F.lit("again"))),
            F.when(F.col("status") == "skip", step("pending", zero)),
        )
    )
    feature = F.concat(
        F.lit('{"uri":'), F.to_json(F.struct("suite")),  # replaced below by the bare string
        F.lit(',"elements":[{"type":"background","steps":[{"result":{"status":"failed"}}]},{"type":"scenario","name":"'),
        "name", F.lit('","steps":['), F.array_join(steps, ","), F.lit("]}]}"),
    )
    feature = F.regexp_replace(feature, r'^\{"uri":\{"suite":("[^"]*")\}', r'{"uri":$1')
    rows = document_cases(spark, sf_dir).withColumn(
        "feature", F.concat(F.when(F.col("seq") < DOC_CASES * _RUNS * F.col("doc") + _RUNS, F.lit("")).otherwise(F.lit(",")), feature)
    )
    path = write_case_documents(rows, F.col("feature"), "[\n", "\n]", "cucumber")
    return ingested(ingest_cucumber(spark, located(path)))


# Coverage


def write_lines(rows: DataFrame, keys: list[str], order: list[str], label: str) -> str:
    """Write `text` rows sorted by (keys, order); rows of equal keys share a file."""
    path = scratch_path(rows.sparkSession, label)
    (
        rows.withColumn("run", F.col("run_id"))
        .repartition("run", *keys)
        .sortWithinPartitions("run", *keys, *order)
        .select("run", "text")
        .write.partitionBy("run")
        .text(path)
    )
    return path


def piece() -> Column:
    """Part of a file's lines, so one file with very many lines is many records."""
    return F.pmod(F.xxhash64("seq"), F.lit(8))


def file_totals(facts: CoverageFacts) -> DataFrame:
    """Totals per run and path, over all entries of the path."""
    files = cov.cov_file_totals(facts.entries, facts.lines, facts.branches, facts.funcs, ENTRY_KEYS)
    return cov.sum_totals(files, base.ENTRY)


def lcov_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = base.lines(spark, sf_dir).withColumn("piece", piece())
    forks = base._project(
        spark, sf_dir, "lineitem", base.BRANCH_COLUMNS | {"seq": base.LINE_COLUMNS["seq"]}
    ).withColumn("piece", piece())
    funcs = base.funcs(spark, sf_dir).withColumn("piece", F.lit(0).cast("bigint"))
    key = ["run_id", "path", "piece"]

    def part(df: DataFrame, kind: int, text: Column, seq: Column | None = None) -> DataFrame:
        order = F.lit(None).cast("bigint") if seq is None else seq
        return df.select(*key, F.lit(kind).alias("kind"), order.alias("seq"), text.alias("text"))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    taken = F.when(F.col("taken") < 0, F.lit("-")).otherwise(F.col("taken").cast("string"))
    records = lines.select(*key).unionByName(funcs.select(*key)).distinct()
    return (
        part(records, 0, text("TN:\nSF:", F.col("path")))
        .unionByName(part(funcs, 1, text("FN:", F.col("line"), ",", F.col("name"), "\nFNDA:", F.col("calls"), ",", F.col("name"))))
        .unionByName(part(lines, 2, text("DA:", F.col("line"), ",", F.col("hits")), F.col("seq")))
        .unionByName(part(forks, 3, text("BRDA:", F.col("line"), ",0,", F.col("idx"), ",", taken), F.col("seq")))
        .unionByName(part(records, 4, F.lit("end_of_record")))
    )


@query(with_tables("files") + "SELECT * FROM files")
def lcov_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_lines(lcov_rows(spark, sf_dir), ["path", "piece"], ["kind", "seq"], "lcov")
    return file_totals(ingest_lcov(spark, located(path)))


@query(
    with_tables(
        "lines", "funcs",
        hits_of="SELECT run_id, path, line, arg_min(hits, seq) AS hits FROM lines GROUP BY ALL",
    )
    + """SELECT run_id, path, count(*) AS lines_total, count(*) FILTER (WHERE hits > 0) AS lines_covered,
    CAST(0 AS BIGINT) AS branch_total, CAST(0 AS BIGINT) AS branch_covered, CAST(0 AS BIGINT) AS func_total,
    CAST(0 AS BIGINT) AS func_covered FROM hits_of GROUP BY ALL"""
)
def gocover_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = base.lines(spark, sf_dir)
    number = F.col("line").cast("string")
    text = F.concat(
        "path", F.lit(":"), number, F.lit(".2,"), number, F.lit(".9 1 "), F.col("hits").cast("string")
    )
    path = write_lines(lines.withColumn("text", text), ["path", "line"], ["seq"], "gocover")
    return file_totals(ingest_gocover(spark, located(path)))


def coverage_documents(spark: SparkSession, sf_dir: str, item: Column, head: str, foot: str, label: str) -> str:
    """Write every line of `lines` as an item of an XML document.

    Items are numbered where they are scanned, so a document holds at most
    DOC_LINES of them however the paths are distributed.
    """
    path = scratch_path(spark, label)
    split = {
        "folder": F.regexp_extract("path", "^(.*)/", 1),
        "base": F.regexp_extract("path", "[^/]*$", 0),
        "id": F.monotonically_increasing_id(),
    }
    rows = base.lines(spark, sf_dir).withColumns(split).withColumn("text", item)
    documents = rows.groupBy(
        F.col("run_id").alias("run"), F.floor(F.col("id") / DOC_LINES).alias("doc")
    ).agg(F.concat(F.lit(head), F.array_join(F.collect_list("text"), "\n"), F.lit(foot)).alias("text"))
    documents.write.partitionBy("run", "doc").text(path, compression="gzip")
    return path


def _totals_sql(lines_total: str, lines_covered: str, func_total: str, func_covered: str) -> str:
    return (
        with_tables("lines")
        + f"""SELECT run_id, path, {lines_total} AS lines_total, {lines_covered} AS lines_covered,
        CAST(0 AS BIGINT) AS branch_total, CAST(0 AS BIGINT) AS branch_covered, {func_total} AS func_total,
        {func_covered} AS func_covered FROM lines GROUP BY run_id, path"""
    )


_HIT = "count(*) FILTER (WHERE hits > 0)"


# A method line, the same line again on the class, and one line more.
@query(_totals_sql("2 * count(*)", f"2 * {_HIT}", "count(*)", _HIT))
def cobertura_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, hits = F.col("line"), F.col("hits")

    def line(at: Column, count: Column) -> Column:
        return tag("line", {"number": at, "hits": count})

    method = tag(
        "method", {"name": F.lit("m"), "line": number, "hits": hits}, tag("lines", {}, line(number, hits))
    )
    item = tag(
        "class", {"name": F.lit("C"), "filename": F.col("path")},
        F.concat(
            tag("methods", {}, method),
            tag("lines", {}, F.concat(line(number, hits + 1), line(number + 1000, hits), line(number + 1000, hits + 1))),
        ),
    )
    path = coverage_documents(
        spark, sf_dir, item, '<coverage line-rate="0"><packages><package name="p"><classes>\n',
        "\n</classes></package></packages></coverage>", "cobertura",
    )
    return file_totals(ingest_cobertura(spark, located(path)))


@query(
    _totals_sql(
        "count(*) FILTER (WHERE line % 3 < 2) + 4 * count(*) FILTER (WHERE line % 3 = 2)",
        "count(*) FILTER (WHERE line % 3 < 2 AND hits > 0) + 3 * count(*) FILTER (WHERE line % 3 = 2)",
        "count(*) FILTER (WHERE line % 3 = 2)",
        "count(*) FILTER (WHERE line % 3 = 2 AND hits > 0)",
    )
)
def clover_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("stmt"), F.lit("cond"), F.lit("method")), (F.col("line") % 3 + 1).cast("int"))
    line = tag("line", {"num": F.col("line"), "type": kind, "count": F.col("hits")})
    metrics = tag("metrics", {"statements": F.lit(4), "coveredstatements": F.lit(3)})
    file = tag("file", {"name": F.col("base")}, F.concat(line, metrics))
    path = coverage_documents(
        spark, sf_dir, tag("package", {"name": F.col("folder")}, file),
        '<coverage clover="3.2"><project>\n', "\n</project></coverage>", "clover",
    )
    return file_totals(ingest_clover(spark, located(path)))


@query(_totals_sql("count(*)", _HIT, "2 * count(*)", _HIT))
def jacoco_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("line")
    methods = F.concat(
        tag("method", {"name": F.lit("on"), "line": number}),
        tag("method", {"name": F.lit("off"), "line": number + 1}),
    )
    item = tag(
        "package", {"name": F.col("folder")},
        F.concat(
            tag("class", {"name": F.lit("C"), "sourcefilename": F.col("base")}, methods),
            tag("sourcefile", {"name": F.col("base")}, tag("line", {"nr": number, "ci": F.col("hits"), "cb": F.lit(0)})),
        ),
    )
    path = coverage_documents(
        spark, sf_dir, item,
        '<!DOCTYPE report PUBLIC "-//JACOCO//DTD Report 1.1//EN" "report.dtd"><report name="r">\n',
        "\n</report>", "jacoco",
    )
    return file_totals(ingest_jacoco(spark, located(path)))


# Plain lines, rules and snapshots


@query(
    with_tables("lines")
    + """SELECT run_id, count(*) AS line_count, CAST(sum(length(concat(path, ' ', line, ' ', hits))) AS BIGINT) AS char_count
    FROM lines GROUP BY run_id""",
    name="scan_artifacts",
)
def scan_artifacts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "path", F.col("line").cast("string"), F.col("hits").cast("string"))
    path = write_lines(base.lines(spark, sf_dir).withColumn("text", text), ["path", "line"], ["seq"], "lines")
    scanned = scan_artifacts(spark, located(path))
    return scanned.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(F.length("value")).alias("char_count")
    )


@query(
    with_tables("cases", doc_cases=_DOC_CASES)
    + """SELECT DISTINCT run_id, doc, CASE run_id WHEN 'run0' THEN 'junit' WHEN 'run1' THEN 'tap' ELSE 'gotest' END AS format
    FROM doc_cases"""
)
def detect_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.to_json(F.struct(F.lit("run").alias("Action"), F.col("suite").alias("Package"), F.col("name").alias("Test")))
    line = (
        F.when(F.col("run_id") == "run0", F.lit("<testsuites/>"))
        .when(F.col("run_id") == "run1", F.lit("ok 1"))
        .otherwise(event)
    )
    first = F.when(F.col("run_id") == "run0", F.lit("")).when(F.col("run_id") == "run1", F.lit("1..9\n")).otherwise(F.lit(""))
    rows = document_cases(spark, sf_dir).withColumn("line_text", F.concat(first, line))
    path = write_case_documents(rows, F.col("line_text"), "", "\n", "mixed")
    found = registry.detect_artifacts(spark, located(path), registry.TESTS)
    return found.select(
        "run_id", F.regexp_extract("source", r"doc=(\d+)", 1).cast("int").alias("doc"), "format"
    )


@query(
    """SELECT concat('/src/s', CAST(s_suppkey AS VARCHAR), '/') AS pattern,
    concat('@team', CAST(s_suppkey % 7 AS VARCHAR), ' @lead') AS owners FROM supplier WHERE s_suppkey % 5 > 1"""
)
def owner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rule = F.concat(
        F.lit("  /src/s"), key.cast("string"), F.lit("/\t@team"), (key % 7).cast("string"), F.lit("  @lead ")
    )
    line = (
        F.when(key % 5 == 0, F.concat(F.lit("# "), rule))
        .when(key % 5 == 1, F.concat(F.lit("only-a-pattern"), key.cast("string")))
        .otherwise(rule)
    )
    path = scratch_path(spark, "owners")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select(line.alias("value")).write.text(path)
    return read_rules(spark, path).select("pattern", F.array_join("owners", " ").alias("owners"))


@query(
    with_tables("stats", "cov_stats", "file_pcts", **SNAPSHOT_SQL)
    + """SELECT s.run_id, s.has_tests, s.has_coverage, s.total, s.failed, s.line_pct AS run_pct, s.func_covered, f.path,
    f.line_pct AS file_pct FROM snaps s LEFT JOIN file_pcts f USING (run_id)"""
)
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = base.line_files(spark, sf_dir).withColumn("file_ord", F.lit(0))
    path = scratch_path(spark, "snapshots")
    publish.write_snapshots(snapshots(spark, sf_dir), delta_ops.snapshot_files(files), path)
    loaded = read_snapshots(spark, artifacts(path, run_id=F.regexp_extract(F.col("source"), r"run_id=([^/]+)", 1)))
    flat = flat_snapshots(loaded).select(
        "run_id", "has_tests", "has_coverage", "total", "failed", F.col("line_pct").alias("run_pct"), "func_covered"
    )
    return flat.join(
        loaded_files(loaded).select("run_id", "path", F.col("line_pct").alias("file_pct")), "run_id", "left"
    )
