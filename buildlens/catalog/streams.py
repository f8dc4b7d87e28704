"""Streaming operators as queries: a bounded stream is drained into the scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.catalog import base
from buildlens.catalog.base import query, with_tables
from buildlens.catalog.roundtrips import SECONDS_MS
from buildlens.functions.numbers import nanos_to_millis
from buildlens.session import scratch_path
from buildlens.streaming.gotest import ROCKSDB
from buildlens.streaming.gotest import stream_gotest_cases as gotest_cases
from buildlens.streaming.gotest import stream_run_stats as run_stats

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query(
    with_tables("cases")
    + f"""SELECT run_id, suite, name, status, {SECONDS_MS} AS duration_ms, CASE status WHEN 'fail' THEN concat('got ', message)
    WHEN 'skip' THEN 'later' END AS message FROM cases WHERE status <> 'pass' OR seq % 3 > 0"""
)
def stream_gotest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events per case; every third passing test never ends."""

    def event(action, second: int, **more):
        moment = F.timestamp_seconds(F.col("seq") * 10 + second)
        return F.to_json(
            F.struct(
                F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Time"),
                (F.lit(action) if isinstance(action, str) else action).alias("Action"),
                F.concat("suite", F.lit("/"), F.col("seq").cast("string")).alias("Package"),
                F.col("name").alias("Test"),
                *[value.alias(key) for key, value in more.items()],
            )
        )

    said = F.when(F.col("status") == "fail", F.concat(F.lit("got "), "message")).otherwise(F.lit("later"))
    ms = nanos_to_millis(F.col("duration_ns"))
    never = (F.col("status") == "pass") & (F.col("seq") % 3 == 0)
    end = F.when(~never, event(F.col("status"), 2, Elapsed=ms / 1000.0))
    events = F.array_compact(F.array(event("run", 0), event("output", 1, Output=said), end))
    feed = scratch_path(spark, "feed")
    base.cases(spark, sf_dir).select(F.col("run_id").alias("run"), F.explode(events).alias("text")).write.partitionBy(
        "run"
    ).text(feed)

    lines = (
        spark.readStream.format("text").schema("value STRING").load(f"{feed}/run=*")
        .withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)", 1))
    )
    out = scratch_path(spark, "stream-cases")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        (
            gotest_cases(lines).writeStream.format("parquet")
            .option("checkpointLocation", scratch_path(spark, "stream-state"))
            .outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        )
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.parquet(out).select(
        "run_id", F.regexp_replace("suite", "/[0-9]+$", "").alias("suite"), "name", "status",
        nanos_to_millis(F.col("duration_ns")).alias("duration_ms"), "message",
    )


@query(with_tables("stats") + "SELECT * FROM stats")
def stream_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals as they stand when the stream is drained."""
    table = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(table).schema
    status = base.CASE_COLUMNS["status"]
    landing = (
        spark.readStream.schema(schema).parquet(table + "*")
        .selectExpr(f"{base.CASE_COLUMNS['run_id']} AS run_id", f"{status} AS status")
    )
    out = scratch_path(spark, "stream-stats")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    (
        run_stats(landing).writeStream.foreachBatch(keep)
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .outputMode("update").trigger(availableNow=True).start().awaitTermination()
    )
    columns = ["total", "passed", "failed", "skipped"]
    updates = spark.read.parquet(out)
    latest = updates.groupBy("run_id").agg(F.max_by(F.struct(*columns), "batch").alias("last"))
    return latest.select("run_id", "last.*")
