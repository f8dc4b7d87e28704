"""Clover XML documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import numbers_between, parse_int_or_zero
from buildlens.functions.text import blank_to_null
from buildlens.schemas import COV_RECORDS, ENTRY_KEYS
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, list_sources, scan_documents
from buildlens.sources.xmlcoverage import exploded_entries
from buildlens.sources.xmltext import array_or_empty, text_or_empty

_FILE = (
    "STRUCT<_name: STRING, _path: STRING, line: ARRAY<STRUCT<_num: STRING, _type: STRING, _count: STRING>>, "
    "metrics: STRUCT<_statements: INT, _coveredstatements: INT>>"
)
_SCHEMA = f"project STRUCT<file: ARRAY<{_FILE}>, package: ARRAY<STRUCT<_name: STRING, file: ARRAY<{_FILE}>>>>"
_ENTRY = (
    f"struct<path: string, lines: {COV_RECORDS['lines']}, branches: {COV_RECORDS['branches']}, "
    f"funcs: {COV_RECORDS['funcs']}, statements: bigint, covered: bigint>"
)


def _entry(file: Column, package: Column) -> Column:
    name, package = text_or_empty(file["_name"]), text_or_empty(package)
    path = F.coalesce(blank_to_null(file["_path"]), name)
    path = F.when((package != "") & (path == name), F.concat(package, F.lit("/"), name)).otherwise(path)
    reported = F.transform(
        F.filter(file["line"], lambda x: x["_type"].isin("stmt", "cond")),
        lambda x: facts.line_struct(parse_int_or_zero(x["_num"]), parse_int_or_zero(x["_count"])),
    )
    methods = F.transform(
        F.filter(file["line"], lambda x: x["_type"] == "method"),
        lambda x: facts.func_struct(F.lit(""), parse_int_or_zero(x["_num"]), parse_int_or_zero(x["_count"])),
    )
    totals = F.when(F.coalesce(F.size(reported), F.lit(0)) <= 0, file["metrics"])
    return F.struct(
        path.alias("path"), reported.alias("lines"), F.lit(None).alias("branches"), methods.alias("funcs"),
        totals["_statements"].alias("statements"), totals["_coveredstatements"].alias("covered"),
    ).cast(_ENTRY)


def _entries(doc: Column) -> Column:
    """Files of the project, then those of its packages."""
    top = F.transform(doc["project"]["file"], lambda f: _entry(f, F.lit("")))
    packed = F.flatten(
        F.transform(
            doc["project"]["package"],
            lambda p: array_or_empty(F.transform(p["file"], lambda f: _entry(f, p["_name"])), _ENTRY),
        )
    )
    return F.concat(array_or_empty(top, _ENTRY), array_or_empty(packed, _ENTRY))


def ingest_clover(spark: SparkSession, inputs: Artifacts) -> facts.CoverageFacts:
    """One entry per file element; true and false counts are not used.

    A file that reports totals only has lines 1 to its number of statements.
    """
    docs = scan_documents(spark, inputs)
    rows, rejected = exploded_entries(docs, _SCHEMA, "coverage", _entries, "clover")
    entries = rows.select("*", "entry.*").drop("entry")
    found = facts.coverage_facts(entries, list_sources(spark, inputs), rejected)
    counted = numbers_between(entries.withColumn("_one", F.lit(1)), "_one", "statements", "line")
    hits = (F.col("line") <= F.coalesce("covered", F.lit(0))).cast("bigint")
    return replace(found, lines=found.lines.unionByName(counted.select(*ENTRY_KEYS, "line", hits.alias("hits"))))
