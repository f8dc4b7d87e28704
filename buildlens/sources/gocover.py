"""Go coverage profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import numbers_between, parse_int
from buildlens.functions.text import trim_space
from buildlens.plans.inrow import let
from buildlens.plans.skew import attach
from buildlens.schemas import COV_RECORDS, ENTRY_KEYS, REJECTS, record_seq
from buildlens.session import materialize
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, list_sources, scan_artifacts


def gocover_blocks(lines: DataFrame) -> DataFrame:
    """Statement blocks of `path:sl.sc,el.ec statements count`; other lines fall out."""
    def line_of(corner: Column) -> Column:
        return parse_int(F.substring_index(corner, ".", 1))

    def block(text: Column) -> Column:
        rest = F.substring_index(text, ":", -1)
        path = F.left(text, F.length(text) - F.length(rest) - 1)
        fields = F.filter(F.split(rest, r"\s+"), lambda x: x != "")
        return let(fields, lambda f: let(F.split(F.get(f, F.lit(0)), ","), lambda corners: parsed(text, path, f, corners)))

    def parsed(text: Column, path: Column, fields: Column, corners: Column) -> Column:
        found = F.struct(
            path.alias("path"),
            line_of(F.get(corners, F.lit(0))).alias("start"),
            line_of(F.get(corners, F.lit(1))).alias("end"),
            parse_int(F.get(fields, F.lit(1))).alias("statements"),
            parse_int(F.get(fields, F.lit(2))).alias("count"),
        )
        return F.when(~text.startswith("mode:") & (F.size(fields) >= 3) & (F.size(corners) == 2), found)

    def whole(x: Column) -> Column:
        return x["start"].isNotNull() & x["end"].isNotNull() & x["statements"].isNotNull() & x["count"].isNotNull()

    # A generator, so a line is taken apart once; a filter behind it would repeat the work.
    blocks = F.filter(F.array(let(trim_space(F.col("value")), block)), whole)
    return lines.where(F.col("value").contains(":")).select("run_id", "source", "source_ord", "seq", F.inline(blocks))


def first_block_wins(hits: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per (keys, line): the hits of the first block that names the line."""
    return hits.groupBy(*keys, "line").agg(F.min_by("hits", seq).alias("hits"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """Blocks spread over their lines; a block without statements has no hits."""
    hits = F.when(F.col("statements") == 0, F.lit(0).cast("bigint")).otherwise(F.col("count"))
    return numbers_between(blocks.withColumn("hits", hits), "start", "end", "line")


def ingest_gocover(spark: SparkSession, inputs: Artifacts) -> facts.CoverageFacts:
    """Line hits per file; a path is one entry per profile, in order of first appearance."""
    scanned = scan_artifacts(spark, inputs)
    blocks = materialize(gocover_blocks(scanned), "gocover")
    source_keys = ["run_id", "source", "source_ord", "path"]
    first = blocks.groupBy(*source_keys).agg(F.min("seq").alias("first"))
    entries = materialize(first.withColumn("file_ord", record_seq(F.col("first"))).select(*ENTRY_KEYS), "gocover-entries")
    lines = first_block_wins(block_lines(attach(blocks, entries, source_keys)), ENTRY_KEYS)
    nothing = facts.no_rows(scanned, COV_RECORDS)
    return facts.CoverageFacts(
        entries,
        lines.select(*ENTRY_KEYS, "line", "hits"),
        nothing.select(*ENTRY_KEYS, F.inline("branches")),
        nothing.select(*ENTRY_KEYS, F.inline("funcs")),
        list_sources(spark, inputs),
        facts.no_rows(scanned, REJECTS),
    )
