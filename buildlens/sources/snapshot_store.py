"""Snapshots kept as tables: a small summary row per run, and its paths as bucketed rows.

Paths of every run are hashed into the same buckets, so two runs are compared bucket by bucket
without a shuffle, and no run is ever one value or one task. A run that is saved again gets a
newer batch; the summary, written last, says which batch counts. JSON files are an exchange
format: `import_json` takes them in and `export_json` writes them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.operators import deltas, publish
from buildlens.operators.deltas import SNAPSHOT_VERSION
from buildlens.schemas import conform
from buildlens.session import materialize
from buildlens.sources.scan import Artifacts
from buildlens.sources.snapshots import flat_snapshots, loaded_files, read_snapshots

BUCKETS = 32

SUMMARY = {
    "run_id": "string", "version": "int", "timestamp": "timestamp", "label": "string",
    **dict.fromkeys(deltas.COUNTS, "bigint"),
    **dict.fromkeys(("lines_total", "lines_covered", "branch_total", "branch_covered", "func_total", "func_covered"), "bigint"),
    **dict.fromkeys(deltas.SHARES, "double"),
    "has_tests": "boolean", "has_coverage": "boolean",
}
FILES = {"run_id": "string", "path": "string", "line_pct": "double"}
_PLACE = {"batch": "bigint", "batch_day": "date"}


@dataclass(frozen=True)
class SnapshotStore:
    """The tables `name`_runs and `name`_files below `location`, which every executor can reach."""

    spark: SparkSession
    name: str
    location: str
    buckets: int = BUCKETS

    def open(self) -> SnapshotStore:
        """Declare the tables in this session's catalog; what lies at the location already is found."""
        for part, schema, clause in (
            ("runs", SUMMARY, ""), ("files", FILES, f"CLUSTERED BY (path) SORTED BY (path) INTO {self.buckets} BUCKETS"),
        ):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{part}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
            columns = ", ".join(f"`{c}` {kind}" for c, kind in (schema | _PLACE).items())
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name}_{part} ({columns}) USING parquet PARTITIONED BY (batch_day) "
                f"{clause} LOCATION '{self.location}/{part}'"
            )
            self.spark.catalog.recoverPartitions(f"{self.name}_{part}")
        return self

    def _append(self, df: DataFrame, part: str, schema: dict[str, str], batch: int) -> None:
        day = datetime.fromtimestamp(batch / 1e9, UTC).date()
        values = {c: F.col(c) for c in schema if c in df.columns}
        rows = df.select(*conform(schema, **values), F.lit(batch).cast("bigint").alias("batch"), F.lit(day).alias("batch_day"))
        if part == "files":
            # As the buckets are dealt, so each is written by one task.
            rows = rows.repartition(self.buckets, "path")
        rows.write.insertInto(f"{self.name}_{part}")

    def save(self, snapshots: DataFrame, files: DataFrame | None = None, batch: int | None = None) -> int:
        """Add runs (as `build_snapshots` makes them) and their paths; a run that is there is replaced.

        The number of the batch grows with time. It is written on the paths before the summary names it.
        """
        batch = time.time_ns() if batch is None else batch
        if files is not None:
            self._append(files, "files", FILES, batch)
        self._append(snapshots, "runs", SUMMARY, batch)
        return batch

    def runs(self) -> DataFrame:
        """The latest summary of every run."""
        rows = self.spark.table(f"{self.name}_runs")
        latest = rows.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "run_id"]), "batch").alias("s"))
        return latest.select("run_id", "s.*")

    def _latest(self, run_id: str) -> tuple[int, date]:
        """Batch of a run, which must be of a version that this code knows."""
        rows = self.spark.table(f"{self.name}_runs").where(F.col("run_id") == run_id)
        row = rows.orderBy(F.desc("batch")).select("batch", "batch_day", "version").first()
        if row is None:
            raise LookupError(f"no snapshot of run {run_id!r}")
        if (row["version"] or 0) > SNAPSHOT_VERSION:
            raise ValueError(f"run {run_id!r} was saved with version {row['version']}; known are versions up to {SNAPSHOT_VERSION}")
        return row["batch"], row["batch_day"]

    def run(self, run_id: str) -> DataFrame:
        """The summary row of a run."""
        batch, day = self._latest(run_id)
        return self.spark.table(f"{self.name}_runs").where(
            (F.col("run_id") == run_id) & (F.col("batch") == batch) & (F.col("batch_day") == F.lit(day))
        )

    def files(self, run_id: str) -> DataFrame:
        """(path, line_pct) of a run, read from its batch's folder only."""
        batch, day = self._latest(run_id)
        wanted = (F.col("run_id") == run_id) & (F.col("batch") == batch) & (F.col("batch_day") == F.lit(day))
        return self.spark.table(f"{self.name}_files").where(wanted).select("path", "line_pct")

    def file_deltas(self, base: str, current: str) -> DataFrame:
        """(path, delta) of the paths that both runs have and that changed, bucket against bucket."""
        return deltas.file_deltas(self.files(base).hint("merge"), self.files(current), [])

    def run_delta(self, base: str, current: str) -> DataFrame:
        """Differences of the summaries of two runs."""
        pair = [self.run(r).withColumn("pair", F.lit(f"{base} to {current}")) for r in (base, current)]
        return deltas.run_delta(*pair, ["pair"]).drop("pair")

    def export_json(self, path: str) -> None:
        """The latest snapshot of every run as a JSON file below a folder of its name."""
        runs = materialize(self.runs(), "snapshot-runs")
        files = self.spark.table(f"{self.name}_files").join(runs.select("run_id", "batch"), ["run_id", "batch"], "left_semi")
        publish.write_snapshots(runs.drop("batch", "batch_day"), files.select("run_id", "path", "line_pct"), path)

    def import_json(self, inputs: Artifacts, batch: int | None = None) -> int:
        """Save the snapshots of JSON files."""
        loaded = read_snapshots(self.spark, inputs)
        return self.save(flat_snapshots(loaded), loaded_files(loaded), batch)
