"""Snapshots and comparisons as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.catalog import base
from buildlens.catalog.base import query, with_tables
from buildlens.operators import deltas as ops
from buildlens.plans.rank import numbered
from buildlens.session import scratch_path
from buildlens.sources.snapshot_store import SnapshotStore

_FILE_PAIR = """SELECT b.path, c.line_pct - b.line_pct AS delta
    FROM (SELECT * FROM file_pcts WHERE run_id = 'base') b
    JOIN (SELECT * FROM file_pcts WHERE run_id = 'cur') c USING (path)
    WHERE c.line_pct - b.line_pct <> 0"""
STAMP = "2024-01-01T00:00:00Z"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of the runs base and cur; runs 0 and 1 supply their tests."""
    renamed = F.when(F.col("run_id") == "run0", "base").when(F.col("run_id") == "run1", "cur")
    cases = base.cases(spark, sf_dir).withColumn("run_id", F.coalesce(renamed, F.col("run_id")))
    stamp = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    label = F.when(F.col("run_id") != "cur", F.col("run_id"))
    return ops.build_snapshots(cases, base.files(spark, sf_dir), stamp, label)


SNAPSHOT_SQL = {
    "tests": """SELECT CASE run_id WHEN 'run0' THEN 'base' WHEN 'run1' THEN 'cur' ELSE run_id END AS run_id,
        total, passed, failed, skipped FROM stats""",
    "snaps": """SELECT coalesce(t.run_id, c.run_id) AS run_id, t.* EXCLUDE (run_id), c.* EXCLUDE (run_id),
        t.run_id IS NOT NULL AS has_tests, c.run_id IS NOT NULL AS has_coverage
        FROM tests t FULL OUTER JOIN cov_stats c ON t.run_id = c.run_id""",
}


@query(
    with_tables("stats", "cov_stats", **SNAPSHOT_SQL)
    + """SELECT *, 1 AS version, CASE WHEN run_id <> 'cur' THEN run_id END AS label FROM snaps"""
)
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).drop("timestamp")


# Every input is a run of its own here; its entries may repeat a path, and the last one gives the percentage.
@query(
    with_tables("source_files")
    + f"""SELECT concat(run_id, '/', source_ord) AS run_id, path, {base.pct_sql('lines_covered', 'lines_total')} AS line_pct FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, source_ord, path ORDER BY file_ord DESC) AS rn FROM source_files)
      WHERE rn = 1"""
)
def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = base.source_files(spark, sf_dir)
    return ops.snapshot_files(entries.withColumn("run_id", F.concat_ws("/", "run_id", "source_ord")))


@query(with_tables("file_pcts") + f"SELECT *, row_number() OVER (ORDER BY path) AS place FROM ({_FILE_PAIR})")
def file_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(changed_files(spark, sf_dir))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = ops.snapshot_files(base.line_files(spark, sf_dir).withColumn("file_ord", F.lit(0)))
    return ops.deltas_by_path(
        ops.file_deltas(base.of_run(shares, "base"), base.of_run(shares, "cur"), [])
    )


def stored_snapshots(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """The snapshots of all runs as tables; run cur is saved twice, and the second time counts."""
    place = scratch_path(spark, "snapshots")
    store = SnapshotStore(spark, "snapshots_" + place[-32:], place).open()
    files = base.line_files(spark, sf_dir).withColumn("file_ord", F.lit(0))
    runs, shares = snapshots(spark, sf_dir), ops.snapshot_files(files)
    store.save(runs.withColumn("total", F.lit(0)), shares.withColumn("line_pct", F.lit(-1.0)), batch=1)
    store.save(runs, shares)
    return store


@query(with_tables("file_pcts") + _FILE_PAIR)
def stored_file_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_snapshots(spark, sf_dir).file_deltas("base", "cur")


@query(
    with_tables("stats", "cov_stats", **SNAPSHOT_SQL)
    + """SELECT * EXCLUDE (file_count), 1 AS version, CASE WHEN run_id <> 'cur' THEN run_id END AS label FROM snaps"""
)
def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_snapshots(spark, sf_dir).runs().drop("timestamp", "batch", "batch_day")


@query(
    with_tables("view", "file_pcts", deltas=_FILE_PAIR)
    + "SELECT v.* EXCLUDE (run_id), d.delta FROM view v LEFT JOIN deltas d USING (path) WHERE v.run_id = 'cur'"
)
def cov_rows_with_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = base.of_run(base.view(spark, sf_dir), "cur")
    return ops.cov_rows_with_delta(view, changed_files(spark, sf_dir))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of every run against the run base."""
    all_runs = snapshots(spark, sf_dir).withColumn("pair_id", F.lit("vs base"))
    current = all_runs.where("run_id <> 'base'")
    baseline = all_runs.where("run_id = 'base'").drop("run_id")
    named = current.select("pair_id", "run_id")
    return ops.run_delta(
        named.join(F.broadcast(baseline), "pair_id"), current, ["pair_id", "run_id"]
    ).drop("pair_id")


_DELTA_COLUMNS = ", ".join(
    [f"c.{n} - b.{n} AS {n}_delta" for n in ops.COUNTS]
    + [f"c.{n} - b.{n} AS {n}_delta" for n in ops.SHARES]
)
_PAIR_SQL = with_tables("stats", "cov_stats", **SNAPSHOT_SQL, pairs=f"""SELECT c.run_id, b.has_tests AND c.has_tests AS has_tests,
    b.has_coverage AND c.has_coverage AS has_coverage, {_DELTA_COLUMNS}
    FROM (SELECT * FROM snaps WHERE run_id <> 'base') c, (SELECT * FROM snaps WHERE run_id = 'base') b""")


@query(_PAIR_SQL + "SELECT * FROM pairs")
def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir)


def _signed(column: str, text: str) -> str:
    return f"concat(CASE WHEN {column} > 0 THEN '+' ELSE '' END, {text})"


@query(
    _PAIR_SQL
    + f"""SELECT run_id, {_signed('failed_delta', 'CAST(failed_delta AS VARCHAR)')} AS failed_text,
    CASE WHEN failed_delta = 0 THEN 'none' WHEN failed_delta > 0 THEN 'red' ELSE 'none' END AS failed_colour,
    {_signed('passed_delta', 'CAST(passed_delta AS VARCHAR)')} AS passed_text,
    CASE WHEN passed_delta = 0 THEN 'none' WHEN passed_delta < 0 THEN 'red' ELSE 'green' END AS passed_colour,
    CASE WHEN line_pct_delta IS NOT NULL THEN {_signed('line_pct_delta', "printf('%.1f%%', line_pct_delta)")} END AS line_text
    FROM pairs"""
)
def delta_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ops.with_delta_texts(paired(spark, sf_dir), ["failed_delta", "passed_delta"], ["line_pct_delta"])
    return texts.select(
        "run_id",
        F.col("failed_delta_text").alias("failed_text"), F.col("failed_delta_colour").alias("failed_colour"),
        F.col("passed_delta_text").alias("passed_text"), F.col("passed_delta_colour").alias("passed_colour"),
        F.col("line_pct_delta_text").alias("line_text"),
    )


_COLOUR = "CASE WHEN line_pct >= 80 THEN '#4c1' WHEN line_pct >= 50 THEN '#dfb317' ELSE '#e05d44' END"


@query(
    with_tables("stats", "cov_stats", **SNAPSHOT_SQL, badges=f"""
      SELECT run_id, 'coverage' AS label, printf('%.1f%%', line_pct) AS value, {_COLOUR} AS colour
        FROM snaps WHERE has_coverage
      UNION ALL SELECT run_id, 'tests', concat(CAST(passed AS VARCHAR), '/', CAST(total AS VARCHAR)),
        CASE WHEN failed > 0 OR passed < total THEN '#e05d44' ELSE '#4c1' END FROM snaps WHERE has_tests""")
    + "SELECT *, CAST(length(label) * 7 + 24 AS INT) AS label_width, CAST(length(value) * 7 + 24 AS INT) AS value_width FROM badges"
)
def badge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.badge_rows(snapshots(spark, sf_dir))
