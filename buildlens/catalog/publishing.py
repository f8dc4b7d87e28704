"""Published texts as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.catalog import base
from buildlens.catalog.base import query, with_tables
from buildlens.catalog.deltas import SNAPSHOT_SQL, STAMP, snapshots
from buildlens.operators import deltas as delta_ops
from buildlens.operators import publish as ops
from buildlens.operators.cases import test_stats
from buildlens.operators.coverage import TOTALS
from buildlens.plans.rank import numbered

URI = "https://example.org/buildlens"


def json_object(*fields: tuple[str, str]) -> str:
    """SQL text of a JSON object; a field whose value is null is left out."""
    parts = [f"CASE WHEN {value} IS NOT NULL THEN concat('\"{name}\":', to_json({value}), ',') ELSE '' END"
             for name, value in fields]
    return f"concat('{{', rtrim(concat({', '.join(parts)}), ','), '}}')"


_CASE_JSON = json_object(
    ("name", "name"), ("status", "status"), ("duration_ms", "duration_ms"),
    ("message", "message"), ("file", "file"), ("line", "nullif(line, 0)"),
)

def _metric_sql(label: str, kind: str, counts: str) -> str:
    emoji = f"CASE WHEN {kind}_pct >= 80 THEN '🟢' WHEN {kind}_pct >= 50 THEN '🟡' ELSE '🔴' END"
    return f"concat('| ', {emoji}, ' {label} | ', {counts}_covered, ' | ', {counts}_total, ' | ', printf('%.1f', {kind}_pct), '% |')"


def joined_texts(rows: DataFrame) -> DataFrame:
    """Rows of a document without their order."""
    return rows.select("run_id", "text")


def in_place(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of documents, one run behind the other, with their place."""
    return numbered(joined_texts(rows.orderBy("run_id", *(order or ("ord",)))))


# Every case is one row of the document; opening and closing marks of suites go
# with the first case of a suite. The head holds a percentage, whose digits the
# engines print alike.
@query(
    with_tables(
        "cases", "stats",
        seen="SELECT *, min(seq) OVER (PARTITION BY run_id, suite) AS s, min(seq) OVER (PARTITION BY run_id) AS r FROM cases",
    )
    + f"""SELECT run_id, text, row_number() OVER (ORDER BY run_id, section, s, seq) AS place FROM (
    SELECT run_id, 1 AS section, s, seq, concat(CASE WHEN seq = s THEN concat(CASE WHEN seq = r THEN '' ELSE ']}},' END,
      '{{"name":', to_json(suite), ',"cases":[') ELSE ',' END, {_CASE_JSON}) AS text FROM seen
    UNION ALL SELECT run_id, 0, 0, 0, concat('{{"generated_at":"{STAMP}","summary":{{"total":', total, ',"passed":', passed,
      ',"failed":', failed, ',"skipped":', skipped, ',"pass_pct":', {base.pct_sql('passed', 'total')}, '}},"suites":[') FROM stats
    UNION ALL SELECT run_id, 2, 0, 0, ']}}]}}' FROM stats)"""
)
def test_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_place(ops.test_report_json(base.cases(spark, sf_dir), STAMP))


# Runs without anything in them: run2 has no case, the run cur no file.

_EMPTY_TESTS = """SELECT r.run_id, count(c.run_id) AS total, count(c.run_id) FILTER (WHERE status IN ('pass', 'flaky')) AS passed,
    count(c.run_id) FILTER (WHERE status = 'fail') AS failed, count(c.run_id) FILTER (WHERE status = 'skip') AS skipped
    FROM (SELECT DISTINCT run_id FROM cases) r LEFT JOIN cases c ON c.run_id = r.run_id AND c.run_id <> 'run2' GROUP BY r.run_id"""
_SHORT_HEAD = f"""concat('{{"generated_at":"{STAMP}","summary":{{"total":', total, ',"passed":', passed,
    ',"failed":', failed, ',"skipped":', skipped, ',"pass_pct":', {base.pct_sql('passed', 'total')}, '}},"suites":',
    CASE WHEN total = 0 THEN 'null}}' ELSE '[' END)"""


@query(
    with_tables("cases", totals=_EMPTY_TESTS)
    + f"""SELECT run_id, text, row_number() OVER (ORDER BY run_id, section) AS place FROM (
    SELECT run_id, 0 AS section, {_SHORT_HEAD} AS text FROM totals
    UNION ALL SELECT run_id, 2, CASE WHEN total = 0 THEN '' ELSE ']}}]}}' END FROM totals)"""
)
def empty_run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and foot of every run's JSON report, that of the empty run included."""
    cases = base.cases(spark, sf_dir)
    report = ops.test_report_json(cases.where("run_id <> 'run2'"), STAMP, cases.select("run_id"))
    return in_place(report.where("ord.section <> 1"))


@query(
    with_tables("cases", totals=_EMPTY_TESTS)
    + f"""SELECT run_id, text, row_number() OVER (ORDER BY run_id, n) AS place FROM (
      SELECT run_id, unnest(texts) AS text, unnest(range(len(texts))) AS n FROM (
        SELECT run_id, [concat('## Test Report', chr(10)), concat('_Generated: {STAMP}_', chr(10)),
        concat('| Metric | Value |', chr(10), '|--------|-------|'), concat('| **Total** | ', total, ' |'),
        concat('| ✅ Passed | ', passed, ' |'), concat('| ❌ Failed | ', failed, ' |'), concat('| ⏭️ Skipped | ', skipped, ' |'),
        concat('| Pass rate | ', printf('%.1f', {base.pct_sql('passed', 'total')}), '% |', chr(10)),
        CASE WHEN failed > 0 THEN concat('### ❌ Failed Tests', chr(10)) END] AS texts FROM totals)) WHERE text IS NOT NULL"""
)
def empty_run_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every run's Markdown report, those of the empty run included."""
    cases = base.cases(spark, sf_dir)
    report = ops.test_markdown_rows(cases.where("run_id <> 'run2'"), STAMP, runs=cases.select("run_id"))
    return in_place(report.where("ord.section = 0"))


_EMPTY_FILES = f"""SELECT *, {base.PCT_SQL} FROM (SELECT r.run_id, count(f.path) AS file_count,
    {', '.join(f"CAST(coalesce(sum(f.{t}), 0) AS BIGINT) AS {t}" for t in TOTALS)}
    FROM (SELECT DISTINCT run_id FROM files) r LEFT JOIN files f ON f.run_id = r.run_id AND f.run_id <> 'cur' GROUP BY r.run_id)"""


@query(
    with_tables("files", totals=_EMPTY_FILES)
    + """SELECT run_id, file_count, line_pct AS lines_pct, lines_covered, lines_total, branch_pct, func_pct,
    CASE WHEN file_count = 0 THEN 'null}' ELSE '[' END AS opens, CASE WHEN file_count = 0 THEN '' ELSE ']}' END AS closes FROM totals"""
)
def empty_run_coverage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and foot of every run's JSON coverage report; percentages are compared as numbers."""
    files = base.files(spark, sf_dir)
    report = ops.cov_report_json(files.where("run_id <> 'cur'"), STAMP, files.select("run_id"))
    text = F.col("text")
    opens = F.regexp_extract("text", r'"files":(.*)$', 1)
    whole = F.from_json(
        F.get_json_object(F.concat(F.regexp_extract("text", r'^(.*),"files":.*$', 1), F.lit("}")), "$.summary"),
        "file_count BIGINT, lines_pct DOUBLE, lines_covered BIGINT, lines_total BIGINT, branch_pct DOUBLE, func_pct DOUBLE",
    )
    head = report.where("ord.section = 0").select("run_id", whole.alias("o"), opens.alias("opens")).select("run_id", "o.*", "opens")
    return head.join(report.where("ord.section = 2").select("run_id", text.alias("closes")), "run_id")


@query(
    with_tables("files", totals=_EMPTY_FILES)
    + """SELECT run_id, text, row_number() OVER (ORDER BY run_id, n) AS place FROM (
      SELECT run_id, unnest(texts) AS text, unnest(range(len(texts))) AS n FROM (
        SELECT run_id, [{lines}, CASE WHEN branch_total > 0 THEN {branches} END, CASE WHEN func_total > 0 THEN {funcs} END,
        concat('<details><summary>Per-file coverage (', file_count, ' files)</summary>', chr(10))] AS texts FROM totals))
      WHERE text IS NOT NULL""".format(
        lines=_metric_sql("Lines", "line", "lines"), branches=_metric_sql("Branches", "branch", "branch"),
        funcs=_metric_sql("Functions", "func", "func"),
    )
)
def empty_run_coverage_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every run's Markdown coverage report, those of the empty run included."""
    files = base.files(spark, sf_dir)
    report = ops.cov_markdown_rows(files.where("run_id <> 'cur'"), STAMP, files.select("run_id"))
    wanted = F.col("text").rlike(r"^\| \S+ (Lines|Branches|Functions) \||^<details>")
    return in_place(report.where((F.col("ord.section") == 0) & wanted))


# Percentages are compared as numbers: the engines may print doubles differently.
@query(
    with_tables("file_pcts", "cov_stats")
    + """SELECT run_id, path, line_pct AS lines_pct, lines_covered, lines_total, nullif(branch_pct, 0) AS branch_pct,
    nullif(branch_covered, 0) AS branch_covered, nullif(branch_total, 0) AS branch_total, nullif(func_pct, 0) AS func_pct,
    nullif(func_covered, 0) AS func_covered, nullif(func_total, 0) AS func_total FROM file_pcts
    UNION ALL SELECT run_id, '{summary}', line_pct, lines_covered, lines_total, branch_pct, branch_covered, branch_total,
    func_pct, func_covered, func_total FROM cov_stats"""
)
def cov_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = (
        "lines_pct DOUBLE, lines_covered BIGINT, lines_total BIGINT, branch_pct DOUBLE, branch_covered BIGINT, "
        "branch_total BIGINT, func_pct DOUBLE, func_covered BIGINT, func_total BIGINT"
    )
    rows = ops.cov_report_json(base.files(spark, sf_dir), STAMP).where("text <> ']}'")
    is_head = F.col("ord.section") == 0
    body = F.when(is_head, F.concat("text", F.lit("]}"))).otherwise(F.ltrim("text", F.lit(",")))
    fields = [c.split()[0] for c in numbers.split(", ")]
    parsed = rows.select(
        "run_id",
        F.when(is_head, F.from_json(F.get_json_object(body, "$.summary"), f"path STRING, {numbers}"))
        .otherwise(F.from_json(body, f"path STRING, {numbers}"))
        .alias("o"),
    )
    return parsed.select(
        "run_id", F.coalesce("o.path", F.lit("{summary}")).alias("path"), *[f"o.{c}" for c in fields]
    )


_TEST_RESULT = """concat('{"ruleId":"test-failure","level":"error","message":{"text":', to_json(concat(name, ': ', message)), '}',
    CASE WHEN file IS NULL THEN '' ELSE concat(',"locations":[{"physicalLocation":{"artifactLocation":{"uri":', to_json(file),
    ',"uriBaseId":"%SRCROOT%"}', CASE WHEN line > 0 THEN concat(',"region":{"startLine":', line, '}') ELSE '' END, '}}]') END, '}')"""


@query(with_tables("cases") + f"SELECT run_id, {_TEST_RESULT} AS text FROM cases WHERE status = 'fail'")
def test_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_texts(ops.test_sarif_results(base.cases(spark, sf_dir)))


@query(
    with_tables("file_pcts")
    + """SELECT run_id, concat('{"ruleId":"coverage-below-threshold","level":"warning","message":{"text":"', path,
    ': line coverage ', printf('%.1f', line_pct), '% is below the threshold of 55.0%."},"locations":[{"physicalLocation":',
    '{"artifactLocation":{"uri":"', path, '","uriBaseId":"%SRCROOT%"}}}]}') AS text FROM file_pcts WHERE line_pct < 55"""
)
def cov_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_texts(ops.cov_sarif_results(base.line_files(spark, sf_dir), 55))


_SARIF_HEAD = (
    '{"$schema":"https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0.json","version":"2.1.0","runs":['
    '{"tool":{"driver":{"name":"buildlens","version":"1.0","informationUri":"' + URI + '","rules":[{"id":"test-failure",'
    '"shortDescription":{"text":"Test case failed"},"fullDescription":{"text":"A test case reported a failure or error."},'
    '"defaultConfiguration":{"level":"error"},"helpUri":"' + URI + '"}]}},"results":['
)


@query(
    with_tables(
        "cases",
        failed="""SELECT *, min(seq) OVER (PARTITION BY run_id, suite) AS s FROM cases""",
        placed="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s, seq) AS rn FROM failed WHERE status = 'fail'",
    )
    + f"""SELECT run_id, concat(CASE WHEN rn = 1 THEN '' ELSE ',' END, {_TEST_RESULT}) AS text FROM placed
    UNION ALL SELECT DISTINCT run_id, '{_SARIF_HEAD}' FROM cases
    UNION ALL SELECT DISTINCT run_id, ']}}]}}' FROM cases"""
)
def sarif_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = base.cases(spark, sf_dir)
    results = ops.test_sarif_results(cases)
    return joined_texts(
        ops.sarif_document(test_stats(cases), results, ops.test_sarif_rule(), "1.0", URI)
    )


_GH = "replace(replace(replace(replace({0}, '%', '%25'), ':', '%3A'), ',', '%2C'), chr(10), '%0A')"
_AZ = "replace(replace({0}, ']', '%5D'), ';', '%3B')"
_FILE = "coalesce(file, replace(suite, '.', '/'))"


@query(
    with_tables("cases")
    + f"""SELECT run_id, seq, platform, text, row_number() OVER (PARTITION BY platform ORDER BY run_id, s, seq) AS place FROM (
    SELECT run_id, seq, 'github' AS platform, concat('::error ', CASE WHEN line > 0 THEN concat('file=', {_GH.format(_FILE)},
      ',line=', line, ',') ELSE '' END, 'title=', name, '::', {_GH.format('message')}) AS text FROM cases WHERE status = 'fail'
    UNION ALL SELECT run_id, seq, 'gitlab', concat(chr(27), '[31mFAIL', chr(27), '[0m  ', suite, ' :: ', name, ' — ', message)
      FROM cases WHERE status = 'fail'
    UNION ALL SELECT run_id, seq, 'azure', concat('##vso[task.logissue type=error;sourcepath=', {_FILE}, ';',
      CASE WHEN line > 0 THEN concat('linenumber=', line, ';') ELSE '' END, 'title=', name, ']', {_AZ.format('message')})
      FROM cases WHERE status = 'fail')
    JOIN (SELECT run_id, seq, min(seq) OVER (PARTITION BY run_id, suite) AS s FROM cases) USING (run_id, seq)"""
)
def test_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = base.cases(spark, sf_dir)
    out = None
    for platform in ops.PLATFORMS:
        rows = numbered(ops.test_annotations(cases, platform).select("run_id", "seq", F.lit(platform).alias("platform"), "text"))
        out = rows if out is None else out.unionByName(rows)
    return out


_DETAIL = """concat(printf('%.1f', line_pct), '{p} line coverage (', lines_covered, '/', lines_total, ' lines) — threshold 60.0{p}')"""
_OVERALL = "concat('overall line coverage ', printf('%.1f', line_pct), '{p} is below threshold 60.0{p}')"


@query(
    with_tables(
        "file_pcts", "cov_stats",
        low="SELECT * FROM file_pcts WHERE lines_total > 0 AND line_pct < 60",
        overall="SELECT * FROM cov_stats WHERE line_pct < 60",
    )
    + f"""SELECT run_id, platform, text, row_number() OVER (PARTITION BY platform ORDER BY run_id, kind, line_pct, path) AS place FROM (
    SELECT run_id, 0 AS kind, line_pct, path, 'github' AS platform, concat('::warning file=', path, ',title=Low Coverage::', {_DETAIL.format(p='%25')}) AS text FROM low
    UNION ALL SELECT run_id, 1, line_pct, '', 'github', concat('::error title=Coverage Below Threshold::', {_OVERALL.format(p='%25')}) FROM overall
    UNION ALL SELECT run_id, 0, line_pct, path, 'gitlab', concat(chr(27), '[33mWARN', chr(27), '[0m  ', path, ' — ', {_DETAIL.format(p='%')}) FROM low
    UNION ALL SELECT run_id, 1, line_pct, '', 'gitlab', concat(chr(27), '[31mFAIL', chr(27), '[0m  ', {_OVERALL.format(p='%')}) FROM overall
    UNION ALL SELECT run_id, 0, line_pct, path, 'azure', concat('##vso[task.logissue type=warning;sourcepath=', path, ']', {_DETAIL.format(p='%')}) FROM low
    UNION ALL SELECT run_id, 1, line_pct, '', 'azure', concat('##vso[task.logissue type=error]', {_OVERALL.format(p='%')}) FROM overall)"""
)
def cov_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = base.line_files(spark, sf_dir)
    out = None
    for platform in ops.PLATFORMS:
        rows = numbered(ops.cov_annotations(files, 60, platform).select("run_id", F.lit(platform).alias("platform"), "text"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    with_tables("cases", "stats")
    + f"""SELECT run_id, concat('#### `', suite, ' / ', name, '`', chr(10), chr(10), '```', chr(10), message, chr(10), '```', chr(10)) AS text
      FROM cases WHERE status = 'fail'
    UNION ALL SELECT run_id, unnest([concat('## Test Report', chr(10)), concat('_Generated: {STAMP}_', chr(10)),
      concat('| Metric | Value |', chr(10), '|--------|-------|'), concat('| **Total** | ', total, ' |'),
      concat('| ✅ Passed | ', passed, ' |'), concat('| ❌ Failed | ', failed, ' |'), concat('| ⏭️ Skipped | ', skipped, ' |'),
      concat('| Pass rate | ', printf('%.1f', {base.pct_sql('passed', 'total')}), '% |', chr(10)),
      concat('### ❌ Failed Tests', chr(10))]) FROM stats"""
)
def test_markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_texts(ops.test_markdown_rows(base.cases(spark, sf_dir), STAMP))


@query(
    with_tables("file_pcts", "cov_stats")
    + f"""SELECT run_id, concat('| `', path, '` | ', printf('%.1f', line_pct), '% | ', lines_covered, '/', lines_total, ' | ',
      CASE WHEN branch_total > 0 THEN printf('%.1f%%', branch_pct) ELSE '–' END, ' | ',
      CASE WHEN func_total > 0 THEN printf('%.1f%%', func_pct) ELSE '–' END, ' |') AS text FROM file_pcts
    UNION ALL SELECT run_id, unnest([concat('## Coverage Report', chr(10)), concat('_Generated: {STAMP}_', chr(10)),
      concat('| Metric | Covered | Total | % |', chr(10), '|--------|---------|-------|----|'),
      {_metric_sql('Lines', 'line', 'lines')}, {_metric_sql('Branches', 'branch', 'branch')},
      {_metric_sql('Functions', 'func', 'func')}, '',
      concat('<details><summary>Per-file coverage (', file_count, ' files)</summary>', chr(10)),
      concat('| File | Lines % | Lines | Branches % | Functions % |', chr(10), '|------|---------|-------|------------|-------------|'),
      concat(chr(10), '</details>', chr(10))]) FROM cov_stats"""
)
def cov_markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_texts(ops.cov_markdown_rows(base.files(spark, sf_dir), STAMP))


@query(
    with_tables("stats", "cov_stats", **SNAPSHOT_SQL)
    + f"""SELECT run_id, 'tests' AS kind, 'buildlens' AS tool, '{STAMP}' AS timestamp, total, passed, failed, skipped,
      {base.pct_sql('passed', 'total')} AS pass_pct, NULL::DOUBLE AS lines_pct, NULL::BIGINT AS lines_covered,
      NULL::BIGINT AS lines_total, NULL::DOUBLE AS branch_pct, NULL::DOUBLE AS func_pct, NULL::BIGINT AS file_count
      FROM snaps WHERE has_tests
    UNION ALL SELECT run_id, 'coverage', 'buildlens', '{STAMP}', NULL, NULL, NULL, NULL, NULL, line_pct, lines_covered,
      lines_total, nullif(branch_pct, 0), nullif(func_pct, 0), file_count FROM snaps WHERE has_coverage"""
)
def notify_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (
        "tool STRING, timestamp STRING, total BIGINT, passed BIGINT, failed BIGINT, skipped BIGINT, pass_pct DOUBLE, "
        "lines_pct DOUBLE, lines_covered BIGINT, lines_total BIGINT, branch_pct DOUBLE, func_pct DOUBLE, file_count BIGINT"
    )
    bodies = ops.notify_payload_rows(snapshots(spark, sf_dir), STAMP)
    return bodies.select("run_id", "kind", F.from_json("body", fields).alias("o")).select("run_id", "kind", "o.*")


@query(
    with_tables("cases")
    + """SELECT run_id, concat('["', suite, '","', name, '","', status, '",', duration_ms, ']') AS text FROM cases"""
)
def view_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("suite", "name", "status", "duration_ms")]
    rows = ops.view_json(
        base.cases(spark, sf_dir)
        .withColumn("duration_ms", (F.col("duration_ns") / 1_000_000).cast("bigint"))
        .select("run_id", *fields)
    )
    o = F.from_json("text", "suite STRING, name STRING, status STRING, duration_ms BIGINT")
    return rows.select("run_id", o.alias("o")).select(
        "run_id",
        F.concat(
            F.lit('["'), "o.suite", F.lit('","'), "o.name", F.lit('","'), "o.status", F.lit('",'),
            F.col("o.duration_ms").cast("string"), F.lit("]"),
        ).alias("text"),
    )


# Snapshot documents: head and footer rows per run, and one row per file.
@query(
    with_tables("stats", "cov_stats", "file_pcts", **SNAPSHOT_SQL)
    + """SELECT run_id, 'path' AS part, path, line_pct FROM file_pcts
    UNION ALL SELECT run_id, 'head', CASE WHEN run_id = 'cur' THEN '' ELSE run_id END, CAST(total AS DOUBLE) FROM snaps
    UNION ALL SELECT run_id, 'foot', CASE WHEN has_coverage THEN '}}}' ELSE '}' END, NULL FROM snaps"""
)
def write_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = base.line_files(spark, sf_dir).withColumn("file_ord", F.lit(0))
    rows = ops.snapshot_documents(snapshots(spark, sf_dir), delta_ops.snapshot_files(files))
    section = F.col("ord.section")
    head = F.concat("text", F.when(F.endswith("text", F.lit('{')), F.lit("}}}")).otherwise(F.lit("}")))
    entry = F.from_json(F.concat(F.lit("{"), F.ltrim("text", F.lit(",")), F.lit("}")), "map<string,double>")
    return rows.select(
        "run_id",
        F.when(section == 0, "head").when(section == 1, "path").otherwise("foot").alias("part"),
        F.when(section == 0, F.coalesce(F.get_json_object(head, "$.label"), F.lit("")))
        .when(section == 1, F.map_keys(entry)[0])
        .otherwise(F.col("text"))
        .alias("path"),
        F.when(section == 0, F.get_json_object(head, "$.tests.total").cast("double"))
        .when(section == 1, F.map_values(entry)[0])
        .alias("line_pct"),
    )
