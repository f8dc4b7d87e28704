"""Coverage operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.catalog import base
from buildlens.catalog.base import query, with_tables
from buildlens.operators import cases as case_ops
from buildlens.operators import coverage as ops
from buildlens.operators import gates, merge
from buildlens.plans.rank import numbered
from buildlens.sources.cobertura import class_line_dedup as dedup_class_lines
from buildlens.sources.gocover import first_block_wins as first_blocks
from buildlens.sources.jacoco import jacoco_func_calls as calls_by_line
from buildlens.sources.lcov import lcov_func_calls as calls_by_name

_VIEW = "SELECT * FROM view"


@query(with_tables("files") + "SELECT * FROM files")
def cov_file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.files(spark, sf_dir)


@query(with_tables("cov_stats") + "SELECT * FROM cov_stats")
def cov_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cov_stats(base.files(spark, sf_dir))


def _placed(rows: str, order: str) -> str:
    """SQL rows with their place in an order."""
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({rows})"


@query(with_tables("view") + _placed(_VIEW, "run_id, path"))
def cov_view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.files_by_path(base.view(spark, sf_dir)))


@query(
    with_tables("view", dirs=f"""SELECT run_id, dir, {base.SUM_SQL}, count(*) AS file_count,
        count(*) FILTER (WHERE line_pct < 60) AS below_count FROM view GROUP BY ALL""")
    + f"SELECT *, {base.PCT_SQL} FROM dirs"
)
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dir_rollup(base.view(spark, sf_dir), 60)


@query(
    with_tables("view", dirs=f"""SELECT run_id, dir, {base.SUM_SQL}, count(*) AS file_count,
        CAST(0 AS BIGINT) AS below_count FROM view GROUP BY ALL""")
    + _placed(f"SELECT *, {base.PCT_SQL} FROM dirs ORDER BY run_id, dir LIMIT 5 OFFSET 5", "run_id, dir")
)
def page_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.page_dirs(base.view(spark, sf_dir), 2, size=5))


@query(
    with_tables("view")
    + "SELECT run_id, count(*) FILTER (WHERE line_pct < 60) AS below_count FROM view GROUP BY run_id"
)
def below_threshold_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.below_threshold_count(base.view(spark, sf_dir), 60)


@query(with_tables("view") + _VIEW + " WHERE line_pct < 45.5")
def below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.view(spark, sf_dir).where(ops.below_threshold(45.5))


@query(
    with_tables("view")
    + """SELECT run_id, path, CASE WHEN line_pct = 0 THEN 'none' WHEN line_pct < 50 THEN 'fail'
      WHEN line_pct < 80 THEN 'warn' ELSE 'pass' END AS band,
    CASE WHEN line_pct >= 80 THEN '#22c55e' WHEN line_pct >= 50 THEN '#f59e0b' ELSE '#ef4444' END AS bar_colour,
    CASE WHEN line_pct >= 80 THEN '#22c55e' WHEN line_pct >= 60 THEN '#84cc16' WHEN line_pct >= 40 THEN '#f59e0b'
      WHEN line_pct >= 20 THEN '#ef4444' ELSE '#991b1b' END AS treemap_colour FROM view"""
)
def coverage_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_bands(base.view(spark, sf_dir)).select("run_id", "path", "band", "bar_colour", "treemap_colour")


@query(with_tables("view") + _VIEW + " WHERE line_pct <> 0 AND line_pct < 50")
def filter_coverage_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filter_coverage_band(base.view(spark, sf_dir), "low")


@query(with_tables("view") + _VIEW + " WHERE contains(lower(path), 'd3/f1') OR contains(lower(dir), 'd3/f1')")
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.search_files(base.view(spark, sf_dir), " D3/F1")


@query(
    with_tables("file_pcts")
    + _placed("SELECT * FROM file_pcts WHERE lines_total > 0 AND line_pct < 60", "run_id, line_pct, path")
)
def worst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.worst_files(base.files(spark, sf_dir), 60))


@query(with_tables("files") + _placed("SELECT * FROM files", "run_id, path"))
def files_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.files_by_path(base.files(spark, sf_dir)))


@query(with_tables("view") + _placed(_VIEW + " WHERE lines_total > 0", "run_id, lines_total DESC, path"))
def files_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.files_by_size(base.view(spark, sf_dir)))


@query(with_tables("view") + _placed(_VIEW, "path DESC, run_id"))
def sort_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.sort_files(base.view(spark, sf_dir), "path", descending=True))


@query(with_tables("view") + _placed(_VIEW + " ORDER BY line_pct, run_id, path LIMIT 200", "line_pct, run_id, path"))
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.page_files(base.view(spark, sf_dir), 1, column="line_pct"))


@query(
    with_tables("view")
    + _placed(f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY lines_total DESC, path) AS rn
      FROM ({_VIEW})) WHERE rn BETWEEN 21 AND 30""", "run_id, lines_total DESC, path")
)
def page_files_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.page_files_of_runs(base.view(spark, sf_dir), 3, size=10, column="lines_total", descending=True))


@query(
    with_tables("view", dirs=f"""SELECT run_id, dir, {base.SUM_SQL}, count(*) AS file_count,
        CAST(0 AS BIGINT) AS below_count, row_number() OVER (PARTITION BY run_id ORDER BY dir) AS rn FROM view GROUP BY run_id, dir""")
    + _placed(f"SELECT * EXCLUDE (rn), {base.PCT_SQL} FROM dirs WHERE rn BETWEEN 4 AND 6", "run_id, dir")
)
def page_dirs_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(ops.page_dirs_of_runs(base.view(spark, sf_dir), 2, size=3))


@query(
    with_tables("files")
    + """SELECT * FROM files WHERE NOT (path LIKE 'src/d1/%' OR regexp_matches(path, '/[^/]*7[.]go$')
    OR regexp_matches(path, '^src/d[2-4]/f1[^/]$'))"""
)
def exclude_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = ["src/d1/**", "*7.go", "src/d[2-4]/f1?", "[bad", "**/deep/x.go"]
    return ops.exclude_paths(base.files(spark, sf_dir), globs)


@query(
    with_tables("files")
    + "SELECT * REPLACE (CASE WHEN path LIKE 'src/d2/%' THEN substr(path, 8) ELSE path END AS path) FROM files"
)
def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.strip_prefix(base.files(spark, sf_dir), "src/d2")


@query(
    with_tables("cov_stats")
    + """SELECT run_id, metric, actual_pct, threshold, threshold > 0 AND actual_pct < threshold AS failed FROM (
      SELECT run_id, 'line' AS metric, line_pct AS actual_pct, CAST(60 AS DOUBLE) AS threshold FROM cov_stats
      UNION ALL SELECT run_id, 'branch', branch_pct, CAST(49.9 AS DOUBLE) FROM cov_stats
      UNION ALL SELECT run_id, 'func', func_pct, CAST(0 AS DOUBLE) FROM cov_stats)"""
)
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.coverage_gate(ops.cov_stats(base.files(spark, sf_dir)), line=60, branch=49.9)


@query(
    with_tables("files")
    + f"""SELECT *, {base.PCT_SQL} FROM (SELECT r.run_id,
    {', '.join(f"CAST(coalesce(sum({t}), 0) AS BIGINT) AS {t}" for t in ops.TOTALS)}, count(f.path) AS file_count
    FROM (SELECT DISTINCT run_id FROM files) r LEFT JOIN files f ON f.run_id = r.run_id AND f.run_id <> 'cur' GROUP BY r.run_id)"""
)
def empty_run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs of the run `cur` name no file; the run still has totals of zero."""
    files = base.files(spark, sf_dir)
    return ops.cov_stats(files.where("run_id <> 'cur'"), runs=files.select("run_id"))


def linked_stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Test totals of base, run0.. and coverage totals of base and cur."""
    renamed = F.when(F.col("run_id") == "run1", "base").otherwise(F.col("run_id"))
    tests = case_ops.test_stats(base.cases(spark, sf_dir)).withColumn("run_id", renamed)
    return tests, ops.cov_stats(base.files(spark, sf_dir))


LINKED = "SELECT CASE WHEN run_id = 'run1' THEN 'base' ELSE run_id END AS run_id, total, passed, failed, skipped FROM stats"


@query(
    with_tables("stats", "cov_stats", tests=LINKED)
    + """SELECT coalesce(t.run_id, c.run_id) AS run_id, t.* EXCLUDE (run_id), c.* EXCLUDE (run_id),
    t.run_id IS NOT NULL AS has_tests, c.run_id IS NOT NULL AS has_coverage
    FROM tests t FULL OUTER JOIN cov_stats c ON t.run_id = c.run_id"""
)
def link_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.link_runs(*linked_stats(spark, sf_dir))


@query(
    with_tables("stats", "cov_stats", tests=LINKED)
    + """SELECT run_id, failed > 0 AS tests_failed, line_pct < 60 AS coverage_failed,
    failed > 0 OR line_pct < 60 AS gate_failed FROM tests JOIN cov_stats USING (run_id)"""
)
def combined_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.combined_gate(*linked_stats(spark, sf_dir), threshold=60)


@query(
    with_tables("stats", "cov_stats", tests=LINKED)
    + """SELECT coalesce(t.run_id, c.run_id) AS run_id,
    CASE WHEN t.failed > 0 THEN 'FAILED' WHEN t.failed = 0 THEN 'PASSED' END AS test_status,
    CASE WHEN round(c.line_pct * 100.0) / 100.0 < 60 THEN 'BELOW THRESHOLD' WHEN c.line_pct IS NOT NULL THEN 'PASS' END
      AS coverage_status FROM tests t FULL OUTER JOIN cov_stats c ON t.run_id = c.run_id"""
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.run_status(*linked_stats(spark, sf_dir), threshold=60)


_FIRST = """SELECT f.*, f.source_ord = m.first_source AS is_first FROM source_files f
    JOIN (SELECT run_id, min(source_ord) AS first_source FROM source_files GROUP BY run_id) m USING (run_id)"""
_LATER = f"SELECT run_id, path, {base.SUM_SQL} FROM tagged WHERE NOT is_first GROUP BY run_id, path"
_PLUS = ", ".join(
    f"a.{t} + CASE WHEN a.file_ord = a.last_ord THEN coalesce(b.{t}, 0) ELSE 0 END AS {t}" for t in ops.TOTALS
)


@query(
    with_tables(
        "source_files",
        tagged=_FIRST,
        later=_LATER,
        firsts="""SELECT *, max(file_ord) OVER (PARTITION BY run_id, path) AS last_ord FROM tagged WHERE is_first""",
    )
    + f"""SELECT a.run_id, a.path, true AS from_first, {_PLUS}
      FROM firsts a LEFT JOIN later b USING (run_id, path)
    UNION ALL SELECT b.run_id, b.path, false, {', '.join('b.' + t for t in ops.TOTALS)}
      FROM later b ANTI JOIN firsts a USING (run_id, path)"""
)
def merge_cov_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_cov_runs(base.source_files(spark, sf_dir)).drop("file_ord")


@query(
    with_tables("lines")
    + "SELECT run_id, path, line, arg_min(hits, seq) AS hits FROM lines GROUP BY run_id, path, line"
)
def first_block_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_blocks(base.lines(spark, sf_dir), base.ENTRY)


# Lines of odd position stand for method lines, the others for class lines.
@query(
    with_tables(
        "lines",
        methods="SELECT run_id, path, line, hits FROM lines WHERE file_ord = 1",
        classes="""SELECT run_id, path, line, arg_min(hits, seq) AS hits FROM lines WHERE file_ord = 0
            GROUP BY run_id, path, line""",
    )
    + "SELECT * FROM methods UNION ALL SELECT * FROM classes ANTI JOIN methods USING (run_id, path, line)"
)
def class_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.lines(spark, sf_dir).withColumnRenamed("seq", "pos")
    return dedup_class_lines(rows.where("file_ord = 1"), rows.where("file_ord = 0"), base.ENTRY)


@query(
    with_tables("lines", "funcs")
    + """SELECT f.run_id, f.path, f.name, f.line,
    CAST(CASE WHEN EXISTS (SELECT 1 FROM lines l WHERE l.run_id = f.run_id AND l.path = f.path AND l.line = f.line
      AND l.hits > 0) THEN 1 ELSE 0 END AS BIGINT) AS calls FROM funcs f"""
)
def jacoco_func_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_by_line(base.funcs(spark, sf_dir), base.lines(spark, sf_dir), base.ENTRY)


# Function names repeat per file: each line stands for one declaration.
_NAMED = "concat('fn', CAST(line % 7 AS {t}))"


@query(
    with_tables(
        "lines",
        declared=f"SELECT run_id, path, {_NAMED.format(t='VARCHAR')} AS name, line FROM lines WHERE file_ord = 1",
        called=f"""SELECT run_id, path, {_NAMED.format(t='VARCHAR')} AS name, arg_max(hits, seq) AS hits
            FROM lines WHERE file_ord = 0 GROUP BY ALL""",
    )
    + """SELECT d.run_id, d.path, d.name, d.line, coalesce(c.hits, 0) AS calls
    FROM declared d LEFT JOIN called c USING (run_id, path, name)"""
)
def lcov_func_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.lines(spark, sf_dir).withColumn("name", F.expr(_NAMED.format(t="string")))
    declared = rows.where("file_ord = 1").select(*base.ENTRY, "name", "line")
    called = rows.where("file_ord = 0").select(*base.ENTRY, "name", "hits", F.col("seq").alias("pos"))
    return calls_by_name(declared, called, base.ENTRY)
