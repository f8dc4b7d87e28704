"""Registry of queries, and the CI-shaped projections of the given tables.

The given tables hold no CI data, so `events` is read as test cases, `lineitem`
as covered lines and branches, and `part` as functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.operators import coverage as cov
from buildlens.operators.cases import collapse_retries
from buildlens.functions.numbers import NANOS_PER_MILLI

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with SQL that gives the same rows."""

    def register(run: Query) -> Query:
        key = name or run.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = run
        if sql is not None:
            _SQL[key] = sql.strip()
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Projections: column name to SQL text that both engines read.

_PATH = "concat('src/d', cast({k} % 8 AS string), '/f', cast({k} AS string), '.go')"
_RUN_OF_LINE = "CASE WHEN l_linestatus = 'O' THEN 'base' ELSE 'cur' END"
_LINE_SEQ = "((l_orderkey * 10 + l_linenumber) * 10000 + l_suppkey) * 100 + cast(floor(l_quantity) AS bigint)"

CASE_COLUMNS = {
    "run_id": "concat('run', cast(event_id % 4 AS string))",
    "source": "concat('src', cast(event_id % 3 AS string), '.xml')",
    "suite": "concat('pkg', cast(user_id % 8 AS string), '.Suite', cast(user_id % 40 AS string))",
    "name": "concat('test', cast(event_id % 20 AS string))",
    "seq": "event_id",
    "status": "CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'pass' END",
    "duration_ms": "cast(floor(value * 10) AS bigint)",
    "message": "CASE WHEN event_type = 'error' THEN concat('value ', props) END",
    "file": "CASE WHEN event_id % 5 <> 0 THEN concat('src/d', cast(user_id % 8 AS string), '/t', "
    "cast(user_id % 40 AS string), '.go') END",
    "line": "CASE WHEN event_id % 5 <> 0 THEN cast(event_id % 300 AS int) END",
}
LINE_COLUMNS = {
    "run_id": _RUN_OF_LINE,
    "source": "concat('cov', cast(l_suppkey % 3 AS string), '.info')",
    "file_ord": "cast(l_linenumber % 2 AS bigint)",
    "path": _PATH.format(k="l_partkey"),
    "line": "cast(l_orderkey % 200 + 1 AS bigint)",
    "hits": "cast(CASE WHEN l_quantity > 20 THEN floor(l_quantity) ELSE 0 END AS bigint)",
    "seq": _LINE_SEQ,
}
BRANCH_COLUMNS = {
    "run_id": _RUN_OF_LINE,
    "source": LINE_COLUMNS["source"],
    "file_ord": LINE_COLUMNS["file_ord"],
    "path": _PATH.format(k="l_partkey"),
    "line": LINE_COLUMNS["line"],
    "idx": "cast(l_linenumber AS bigint)",
    "taken": "cast(CASE l_returnflag WHEN 'A' THEN -1 WHEN 'R' THEN 0 ELSE l_linenumber END AS bigint)",
}


def _project(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(
        *[f"{text} AS {name}" for name, text in columns.items()]
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as test cases."""
    df = _project(spark, sf_dir, "events", CASE_COLUMNS)
    return df.withColumn("duration_ns", F.col("duration_ms") * F.lit(NANOS_PER_MILLI)).drop("duration_ms").withColumns(
        {"stdout": F.lit(None).cast("string"), "attachments": F.lit(None).cast("array<string>")}
    )


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_retries(cases(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "lineitem", LINE_COLUMNS)


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "lineitem", BRANCH_COLUMNS)


def funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as one function per file, called more often in the second run."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        f"{_PATH.format(k='p_partkey')} AS path", "p_name AS name", "cast(p_size AS bigint) AS size",
        "cast(p_size % 200 + 1 AS bigint) AS line",
    )
    cuts = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(c).alias("cut")) for r, c in (("base", 20), ("cur", 15))])
    calls = F.when(F.col("size") > F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("bigint"))
    return parts.select("*", F.inline(cuts)).select("run_id", "path", "name", "line", calls.alias("calls"))


ENTRY = ["run_id", "path"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per file and run."""
    functions = funcs(spark, sf_dir)
    return cov.cov_file_totals(
        functions.select(*ENTRY), lines(spark, sf_dir), branches(spark, sf_dir), functions, ENTRY
    )


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per file and run for queries that look at lines only."""
    entries = funcs(spark, sf_dir).select(*ENTRY)
    return cov.cov_file_totals(entries, lines(spark, sf_dir), None, None, ENTRY)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per file entry of each input; a path may appear twice in one input."""
    keys = ["run_id", "source_ord", "file_ord", "path"]
    details = lines(spark, sf_dir).withColumnRenamed("source", "source_ord")
    forks = branches(spark, sf_dir).withColumnRenamed("source", "source_ord")
    return cov.cov_file_totals(details.select(*keys).distinct(), details, forks, None, keys)


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.cov_view_rows(files(spark, sf_dir))


def of_run(df: DataFrame, run: str) -> DataFrame:
    return df.where(F.col("run_id") == run).drop("run_id")


# The same projections as common table expressions.


def _cte(columns: dict[str, str], table: str) -> str:
    text = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT {text} FROM {table}".replace(" AS string)", " AS varchar)")


def _total(alias: str, column: str) -> str:
    return f"CAST(coalesce({alias}, 0) AS BIGINT) AS {column}"


_PCT = "CASE WHEN {t} = 0 THEN 0.0 ELSE CAST({c} AS DOUBLE) / CAST({t} AS DOUBLE) * 100.0 END"


def pct_sql(covered: str, total: str) -> str:
    return _PCT.format(c=covered, t=total)


PCT_SQL = ", ".join(
    f"{pct_sql(f'{kind}_covered', f'{kind}_total')} AS {name}_pct"
    for kind, name in (("lines", "line"), ("branch", "branch"), ("func", "func"))
)
SUM_SQL = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in cov.TOTALS)

_CTES = {
    "cases": _cte(CASE_COLUMNS, "events"),
    "lines": _cte(LINE_COLUMNS, "lineitem"),
    "branches": _cte(BRANCH_COLUMNS, "lineitem"),
    "funcs": f"""SELECT run_id, {_PATH.format(k='p_partkey').replace('AS string', 'AS varchar')} AS path, p_name AS name,
        CAST(p_size % 200 + 1 AS BIGINT) AS line,
        CAST(CASE WHEN p_size > cut THEN p_size ELSE 0 END AS BIGINT) AS calls
        FROM part CROSS JOIN (SELECT 'base' AS run_id, 20 AS cut UNION ALL SELECT 'cur', 15) r""",
    "retries": """SELECT run_id, source, suite, name, min(seq) AS first_seq,
        max(seq) FILTER (WHERE status = 'pass') AS pass_seq, bool_or(status = 'fail') AS has_fail
        FROM cases GROUP BY ALL""",
    "collapsed": """SELECT c.* EXCLUDE (seq, status), r.first_seq AS seq,
        CASE WHEN r.has_fail AND r.pass_seq IS NOT NULL THEN 'flaky' ELSE c.status END AS status
        FROM retries r JOIN cases c
          ON c.seq = CASE WHEN r.has_fail AND r.pass_seq IS NOT NULL THEN r.pass_seq ELSE r.first_seq END""",
    "stats": """SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status IN ('pass', 'flaky')) AS passed,
        count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'skip') AS skipped
        FROM cases GROUP BY run_id""",
    "files": f"""SELECT f.run_id, f.path, {_total('l.n', 'lines_total')}, {_total('l.c', 'lines_covered')},
        {_total('b.n', 'branch_total')}, {_total('b.c', 'branch_covered')},
        CAST(1 AS BIGINT) AS func_total, CAST(CASE WHEN f.calls > 0 THEN 1 ELSE 0 END AS BIGINT) AS func_covered
        FROM funcs f
        LEFT JOIN (SELECT run_id, path, count(*) AS n, count(*) FILTER (WHERE hits > 0) AS c
                   FROM lines GROUP BY ALL) l USING (run_id, path)
        LEFT JOIN (SELECT run_id, path, count(*) AS n, count(*) FILTER (WHERE taken > 0) AS c
                   FROM branches WHERE taken >= 0 GROUP BY ALL) b USING (run_id, path)""",
    "file_pcts": f"SELECT *, {PCT_SQL} FROM files",
    "view": """SELECT run_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, round(line_pct * 100.0) / 100.0 AS line_pct,
        round(branch_pct * 100.0) / 100.0 AS branch_pct, round(func_pct * 100.0) / 100.0 AS func_pct,
        lines_total, lines_covered, branch_total, branch_covered, func_total, func_covered FROM file_pcts""",
    "cov_sums": f"SELECT run_id, {SUM_SQL}, count(*) AS file_count FROM files GROUP BY run_id",
    "cov_stats": f"SELECT *, {PCT_SQL} FROM cov_sums",
    "source_files": f"""SELECT l.run_id, l.source AS source_ord, l.file_ord, l.path,
        {_total('l.n', 'lines_total')}, {_total('l.c', 'lines_covered')},
        {_total('b.n', 'branch_total')}, {_total('b.c', 'branch_covered')},
        CAST(0 AS BIGINT) AS func_total, CAST(0 AS BIGINT) AS func_covered
        FROM (SELECT run_id, source, file_ord, path, count(*) AS n, count(*) FILTER (WHERE hits > 0) AS c
              FROM lines GROUP BY ALL) l
        LEFT JOIN (SELECT run_id, source, file_ord, path, count(*) AS n, count(*) FILTER (WHERE taken > 0) AS c
                   FROM branches WHERE taken >= 0 GROUP BY ALL) b USING (run_id, source, file_ord, path)""",
}
_NEEDS = {
    "retries": ("cases",),
    "collapsed": ("cases", "retries"),
    "stats": ("cases",),
    "files": ("lines", "branches", "funcs"),
    "file_pcts": ("files",),
    "view": ("file_pcts",),
    "cov_sums": ("files",),
    "cov_stats": ("cov_sums",),
    "source_files": ("lines", "branches"),
}


def with_tables(*names: str, **more: str) -> str:
    """WITH clause of the named expressions, what they need, and further ones."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({_CTES[name]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
