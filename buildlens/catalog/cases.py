"""Test case operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.catalog import base
from buildlens.catalog.base import query, with_tables
from buildlens.functions.numbers import nanos_to_millis
from buildlens.operators import cases as ops
from buildlens.operators import gates, merge
from buildlens.operators.owners import OwnerRule, assign_owners, tag_failures_with_owners
from buildlens.plans.rank import numbered

_CASE_ROW = "run_id, source, suite, name, seq, status, duration_ms, message, file, line"


def case_rows(df: DataFrame) -> DataFrame:
    """Cases with milliseconds, without the always empty columns."""
    return df.withColumn("duration_ms", nanos_to_millis(F.col("duration_ns"))).select(
        *[c.strip() for c in _CASE_ROW.split(",")]
    )


@query(with_tables("stats") + "SELECT * FROM stats")
def test_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.test_stats(base.cases(spark, sf_dir))


@query(
    with_tables("cases")
    + f"""SELECT *, failed > 0 AS gate_failed, {base.pct_sql('passed', 'total')} AS pass_pct FROM (
      SELECT r.run_id, count(c.run_id) AS total, count(c.run_id) FILTER (WHERE status IN ('pass', 'flaky')) AS passed,
        count(c.run_id) FILTER (WHERE status = 'fail') AS failed, count(c.run_id) FILTER (WHERE status = 'skip') AS skipped
      FROM (SELECT DISTINCT run_id FROM cases) r LEFT JOIN cases c ON c.run_id = r.run_id AND c.run_id <> 'run2' GROUP BY r.run_id)"""
)
def empty_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs of run2 hold no case; the run still has totals and a gate."""
    cases = base.cases(spark, sf_dir)
    stats = ops.test_stats(cases.where("run_id <> 'run2'"), runs=cases.select("run_id"))
    return ops.with_status_pcts(stats).drop("fail_pct", "skip_pct").join(
        gates.test_gate(stats).select("run_id", "gate_failed"), "run_id"
    )


@query(
    with_tables("collapsed")
    + "SELECT run_id, count(*) FILTER (WHERE status = 'flaky') AS flaky FROM collapsed GROUP BY run_id"
)
def flaky_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.flaky_count(base.collapsed(spark, sf_dir))


@query(
    with_tables("stats")
    + f"""SELECT *, {base.pct_sql('passed', 'total')} AS pass_pct, {base.pct_sql('failed', 'total')} AS fail_pct,
    {base.pct_sql('skipped', 'total')} AS skip_pct FROM stats"""
)
def pass_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_status_pcts(ops.test_stats(base.cases(spark, sf_dir)))


@query(with_tables("collapsed") + f"SELECT {_CASE_ROW} FROM collapsed")
def collapse_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_rows(base.collapsed(spark, sf_dir))


@query(
    with_tables("cases")
    + """SELECT run_id, suite, count(*) AS tests, count(*) FILTER (WHERE status = 'fail') AS failures,
    count(*) FILTER (WHERE status = 'fail') = 0 AS all_pass FROM cases GROUP BY ALL"""
)
def suite_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.suite_rollup(base.cases(spark, sf_dir))


@query(with_tables("cases") + "SELECT run_id, suite, min(seq) AS first_seq FROM cases GROUP BY ALL")
def first_seen_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = ops.first_seen_suites(base.cases(spark, sf_dir))
    return seen.select("run_id", "suite", F.col("first_seen.seq").alias("first_seq"))


@query(
    with_tables("cases")
    + """SELECT run_id, coalesce(arg_min(duration_ms, seq) FILTER (WHERE duration_ms <> 0), 0) AS junit_ms,
    max(duration_ms) AS gotest_ms, CAST(sum(duration_ms) AS BIGINT) AS tap_ms, CAST(0 AS BIGINT) AS other_ms
    FROM cases GROUP BY run_id"""
)
def run_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(base.cases(spark, sf_dir))
    time, order = F.col("duration_ms"), F.col("seq")
    return rows.groupBy("run_id").agg(
        *[
            ops.run_duration(fmt, time, order).alias(f"{name}_ms")
            for fmt, name in (("junit", "junit"), ("gotest", "gotest"), ("tap", "tap"), ("nunit", "other"))
        ]
    )


@query(with_tables("collapsed") + f"SELECT {_CASE_ROW} FROM collapsed WHERE status = 'flaky'")
def filter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_rows(ops.filter_status(base.collapsed(spark, sf_dir), "flaky"))


@query(with_tables("cases") + f"SELECT {_CASE_ROW} FROM cases WHERE status = 'fail'")
def failed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_rows(ops.failed_only(base.cases(spark, sf_dir)))


@query(
    with_tables("cases")
    + f"SELECT {_CASE_ROW} FROM cases WHERE contains(lower(suite), 'suite1') OR contains(lower(name), 'suite1')"
)
def search_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_rows(ops.search_cases(base.cases(spark, sf_dir), "  SUITE1 "))


@query(
    with_tables("cases")
    + """SELECT run_id, seq, duration_ms,
    CAST(duration_ms AS DOUBLE) >= greatest(max(duration_ms) OVER (PARTITION BY run_id) * 0.1, 100.0) AS slow
    FROM cases WHERE status = 'fail'"""
)
def mark_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ops.mark_slow(ops.filter_status(base.cases(spark, sf_dir), "fail"))
    return marked.select("run_id", "seq", nanos_to_millis(F.col("duration_ns")).alias("duration_ms"), "slow")


# Page texts round the exact binary value; printf does too, but takes ties to
# the even digit, and the page takes them upwards.
@query(
    with_tables(
        "cases",
        timed="SELECT *, max(duration_ms) OVER (PARTITION BY run_id) AS top FROM cases WHERE duration_ms > 0",
        shares="""SELECT *, CAST(duration_ms AS DOUBLE) / CAST(top AS DOUBLE) * 100.0 AS share,
            CAST(duration_ms AS DOUBLE) / 1000.0 AS secs FROM timed""",
    )
    + """SELECT run_id, seq,
    CASE WHEN share - floor(share) = 0.25 THEN printf('%.1f', share + 0.05) ELSE printf('%.1f', share) END AS bar_pct,
    CASE WHEN duration_ms < 1000 THEN concat(CAST(duration_ms AS VARCHAR), 'ms')
      WHEN secs - floor(secs) IN (0.125, 0.625) THEN printf('%.2fs', secs + 0.005)
      ELSE printf('%.2fs', secs) END AS duration_text
    FROM shares"""
)
def timeline_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.timeline_pct(base.cases(spark, sf_dir)).select("run_id", "seq", "bar_pct", "duration_text")


@query(
    with_tables("collapsed")
    + "SELECT run_id, suite, name, status, duration_ms, message, CAST(NULL AS VARCHAR) AS stdout, file, line FROM collapsed"
)
def test_view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.test_view_rows(base.collapsed(spark, sf_dir)).drop("attachments")


@query(
    with_tables("cases")
    + f"SELECT {_CASE_ROW}, row_number() OVER (ORDER BY suite, run_id, source, seq) AS place FROM cases"
)
def sort_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = base.cases(spark, sf_dir).withColumn("source_ord", F.col("source"))
    return numbered(case_rows(ops.sort_cases(cases, "suite")))


@query(
    with_tables("cases")
    + f"""SELECT *, row_number() OVER (ORDER BY duration_ms DESC, run_id, seq) AS place FROM (
      SELECT {_CASE_ROW} FROM cases ORDER BY duration_ms DESC, run_id, seq LIMIT 200 OFFSET 200)"""
)
def page_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(case_rows(ops.page_cases(base.cases(spark, sf_dir), 2, column="duration_ns", descending=True)))


# A page of every run at once; run by run it is clamped to the last one there is.
@query(
    with_tables("cases")
    + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY duration_ms, seq DESC) - 1 AS rn,
      count(*) OVER (PARTITION BY run_id) AS n FROM cases WHERE run_id <> 'run3' OR seq % 100 = 3)
    SELECT {_CASE_ROW}, row_number() OVER (ORDER BY run_id, duration_ms, seq DESC) AS place FROM placed
    WHERE rn // 50 = least(2, (n - 1) // 50)"""
)
def page_cases_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base.cases(spark, sf_dir).where("run_id <> 'run3' OR seq % 100 = 3")
    keys = [(F.col("duration_ns"), False), (F.col("seq"), True)]
    return numbered(case_rows(ops.page_of_each(df, ops.RUN, keys, 3, 50, sort_rows=2000)))


@query(
    with_tables("cases")
    + """SELECT *, row_number() OVER (ORDER BY run_id, suite) AS place FROM (
      SELECT run_id, suite, count(*) AS tests, count(*) FILTER (WHERE status = 'fail') AS failures,
      count(*) FILTER (WHERE status = 'fail') = 0 AS all_pass, row_number() OVER (PARTITION BY run_id ORDER BY suite) AS rn
      FROM cases GROUP BY run_id, suite) WHERE rn BETWEEN 4 AND 6""".replace("SELECT *,", "SELECT * EXCLUDE (rn),")
)
def page_suites_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.page_suites_of_runs(base.cases(spark, sf_dir), 2, size=3))


# A page far past the end is the last page, found without gathering the rows before it.
@query(
    with_tables("cases")
    + f""", numbered AS (SELECT *, row_number() OVER (ORDER BY duration_ms, run_id, seq) - 1 AS rn,
      count(*) OVER () AS n FROM cases)
    SELECT {_CASE_ROW}, row_number() OVER (ORDER BY rn) AS place FROM numbered WHERE rn >= (n - 1) // 200 * 200"""
)
def last_page_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base.cases(spark, sf_dir)
    keys = ops.case_sort_keys(df, "duration_ns")
    return numbered(case_rows(ops.page(df, keys, 10**9, ops.PAGE_TESTS, top_k_rows=0, sort_rows=1000)))


@query(
    with_tables("cases")
    + """SELECT *, row_number() OVER (ORDER BY run_id, suite) AS place FROM (
    SELECT run_id, suite, count(*) AS tests, count(*) FILTER (WHERE status = 'fail') AS failures,
    count(*) FILTER (WHERE status = 'fail') = 0 AS all_pass FROM cases GROUP BY ALL
    ORDER BY run_id, suite LIMIT 50 OFFSET 50)"""
)
def page_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.page_suites(base.cases(spark, sf_dir), 2))


@query(with_tables("stats") + "SELECT run_id, failed AS failed_tests, failed > 0 AS gate_failed FROM stats")
def test_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.test_gate(ops.test_stats(base.cases(spark, sf_dir)))


def input_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per input of a run with its longest case."""
    return base.cases(spark, sf_dir).groupBy("run_id", "source").agg(
        F.max("duration_ns").alias("duration_ns")
    ).withColumn("source_ord", F.col("source"))


@query(
    with_tables("cases")
    + """SELECT run_id, max(duration_ms) * 1000000 AS duration_ns, min(source) AS first_source,
    count(DISTINCT source) AS source_count FROM cases GROUP BY run_id"""
)
def merge_test_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_test_runs(input_runs(spark, sf_dir))


@query(
    with_tables("cases")
    + "SELECT *, row_number() OVER (ORDER BY run_id, source) AS place FROM (SELECT DISTINCT run_id, source FROM cases)"
)
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(merge.merged_sources(input_runs(spark, sf_dir)).drop("source_ord"))


@query(
    with_tables("cases")
    + """SELECT run_id, source, count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS passed,
    count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'skip') AS skipped
    FROM cases GROUP BY ALL"""
)
def no_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.separate_runs(base.cases(spark, sf_dir))


# Suites of one name in several inputs become one, in the order in which the inputs name them.
@query(
    with_tables("collapsed")
    + """SELECT run_id, suite, tests, failures, sources, row_number() OVER (PARTITION BY run_id ORDER BY source, seq) AS place FROM (
      SELECT run_id, suite, count(*) AS tests, count(*) FILTER (WHERE status = 'fail') AS failures, count(DISTINCT source) AS sources,
        min(source) AS source, min_by(seq, (source, seq)) AS seq FROM collapsed GROUP BY run_id, suite)"""
)
def merge_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = base.collapsed(spark, sf_dir).withColumn("source_ord", F.col("source"))
    return merge.merged_suites(cases).drop("first_seen")


OWNER_RULES = [
    OwnerRule("*", ("@all",)),
    OwnerRule("*.go", ("@go", "@lang")),
    OwnerRule("/src/d1/", ("@d1",)),
    OwnerRule("/src/d2/*", ("@d2",)),
    OwnerRule("/src/d3/f1*.go", ("@f1",)),
    OwnerRule("d4/f[0-4]*", ("@low",)),
    OwnerRule("docs/", ("@never",)),
]

_OWNER_SQL = """CASE WHEN {p} LIKE 'src/d4/f%' AND regexp_matches({p}, '^src/d4/f[0-4][^/]*$') THEN '@low'
    WHEN regexp_matches({p}, '^src/d3/f1[^/]*[.]go$') THEN '@f1'
    WHEN {p} LIKE 'src/d2/%' THEN '@d2' WHEN {p} LIKE 'src/d1/%' THEN '@d1'
    WHEN {p} LIKE '%.go' THEN '@go @lang' ELSE '@all' END"""


@query(
    with_tables("files") + f"SELECT run_id, path, {_OWNER_SQL.format(p='path')} AS owners FROM files",
    name="assign_owners",
)
def assign_owners_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = assign_owners(base.files(spark, sf_dir), OWNER_RULES)
    return owned.select("run_id", "path", F.array_join("owners", " ").alias("owners"))


@query(
    with_tables("cases")
    + f"""SELECT run_id, seq, status, CASE WHEN status = 'fail'
      THEN concat('[', {_OWNER_SQL.format(p='coalesce(file, suite)')}, '] ', message) ELSE message END AS message
    FROM cases""",
    name="tag_failures_with_owners",
)
def tag_failures_with_owners_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tag_failures_with_owners(base.cases(spark, sf_dir), OWNER_RULES)
    return tagged.select("run_id", "seq", "status", "message")


# One rule of each supplier: a folder, a tree, a path, an end of it, a name's ending, two globs.
_RULE_PATTERN = """CASE s_suppkey % 7 WHEN 0 THEN concat('/src/d', {m8}, '/') WHEN 1 THEN concat('/src/d', {m8}, '/*')
    WHEN 2 THEN concat('/src/d', {m8}, '/f', {k}, '.go') WHEN 3 THEN concat('d', {m8}, '/f', {k}, '.go')
    WHEN 4 THEN CASE WHEN s_suppkey % 2 = 0 THEN concat('*.x', {k}) ELSE '*.go' END
    WHEN 5 THEN concat('/src/d', {m8}, '/f', {m10}, '*.go') ELSE concat('f[', {m10}, ']', {m10}, '*') END"""


def _rule_pattern(text: str) -> str:
    places = {"k": "s_suppkey", "m8": "s_suppkey % 8", "m10": "s_suppkey % 10"}
    return _RULE_PATTERN.format(**{k: f"cast({v} AS {text})" for k, v in places.items()})


_RULES_SQL = f"""SELECT s_suppkey AS k, {_rule_pattern('varchar')} AS pattern,
    concat('@team', CAST(s_suppkey AS VARCHAR)) AS owner FROM supplier"""
_PATH_RULES_SQL = """SELECT path, max_by(owner, k) AS owners FROM (SELECT DISTINCT path FROM files) f JOIN rules ON CASE k % 7
    WHEN 0 THEN starts_with(path, substr(pattern, 2)) WHEN 1 THEN starts_with(path, substr(pattern, 2, length(pattern) - 2))
    WHEN 2 THEN path = substr(pattern, 2) WHEN 3 THEN ends_with(path, concat('/', pattern))
    WHEN 4 THEN ends_with(path, substr(pattern, 2))
    WHEN 5 THEN starts_with(path, substr(pattern, 2, length(pattern) - 5)) AND ends_with(path, '.go')
    ELSE starts_with(split_part(path, '/', 3), concat('f', CAST(k % 10 AS VARCHAR), CAST(k % 10 AS VARCHAR))) END GROUP BY path"""


def supplier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return suppliers.selectExpr(
        "s_suppkey AS rule_ord", f"{_rule_pattern('string')} AS pattern",
        "array(concat('@team', cast(s_suppkey AS string))) AS owners",
    )


@query(
    with_tables("files", rules=_RULES_SQL, owned=_PATH_RULES_SQL)
    + "SELECT run_id, path, owners FROM files LEFT JOIN owned USING (path)"
)
def owners_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by a table of rules that grows with the data."""
    owned = assign_owners(base.files(spark, sf_dir), supplier_rules(spark, sf_dir))
    return owned.select("run_id", "path", F.array_join("owners", " ").alias("owners"))


@query(
    with_tables("cases", files="SELECT coalesce(file, suite) AS path FROM cases", rules=_RULES_SQL, owned=_PATH_RULES_SQL)
    + """SELECT run_id, seq, CASE WHEN status <> 'fail' OR owners IS NULL THEN message
        ELSE concat('[', owners, '] ', message) END AS message
    FROM cases LEFT JOIN owned ON path = coalesce(file, suite)"""
)
def tag_failures_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tag_failures_with_owners(base.cases(spark, sf_dir), supplier_rules(spark, sf_dir))
    return tagged.select("run_id", "seq", "message")
