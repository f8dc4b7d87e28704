"""Shared shape of the XML coverage readers: parse once, flatten, explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.plans.skew import PART_ROWS, parts_for
from buildlens.schemas import record_seq
from buildlens.session import materialize
from buildlens.sources import facts
from buildlens.sources.xmltext import parsed_documents, root_element


def exploded_entries(docs: DataFrame, schema: str, root: str, entries, label: str) -> tuple[DataFrame, DataFrame]:
    """(entry rows, rejects) of whole documents.

    `entries` maps the parsed document to its array of entries, in document
    order. The parse result is stored, so the tables built from it do not parse
    the text again.
    """
    stored, rejected = parsed_entries(docs, schema, root, entries, label)
    start = F.struct(F.lit(0).alias("block_start"), F.lit(0).alias("row_id"))
    spread = spread_documents(stored).select("run_id", "source", "source_ord", F.posexplode("entries").alias("pos", "entry"))
    return spread.withColumn("file_ord", record_seq(start, F.col("pos"))).drop("pos"), rejected


def spread_documents(stored: DataFrame) -> DataFrame:
    """Documents over as many tasks as their entries need.

    A stored entry has a few bytes only, so a scan's task would hold millions of them.
    """
    entries = stored.agg(F.sum(F.size("entries"))).first()[0] or 0
    return stored if entries <= PART_ROWS else stored.repartition(parts_for(entries, stored), "source")


def parsed_entries(docs: DataFrame, schema: str, root: str, entries, label: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their array of entries, rejects), stored."""
    parsed = parsed_documents(docs, schema)
    broken: Column = F.col("broken") | (root_element(F.col("value")) != root)
    stored = materialize(
        parsed.select(
            "run_id", "source", "source_ord",
            broken.alias("broken"),
            F.when(~broken, entries(F.col("doc"))).alias("entries"),
        ),
        label,
    )
    return stored, facts.rejects(stored.where("broken"), label, "malformed or unexpected XML")
