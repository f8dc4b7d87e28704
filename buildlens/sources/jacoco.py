"""JaCoCo XML documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import parse_int, parse_int_or_zero
from buildlens.functions.text import slash_join
from buildlens.plans.inrow import let, with_last
from buildlens.plans.skew import attach
from buildlens.schemas import COV_RECORDS
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, list_sources, scan_documents
from buildlens.sources.xmlcoverage import exploded_entries
from buildlens.sources.xmltext import array_or_empty, text_or_empty

_CLASS = "STRUCT<_sourcefilename: STRING, method: ARRAY<STRUCT<_name: STRING, _line: STRING>>>"
_SOURCE = "STRUCT<_name: STRING, line: ARRAY<STRUCT<_nr: STRING, _ci: STRING, _cb: STRING>>>"
_SCHEMA = f"package ARRAY<STRUCT<_name: STRING, class: ARRAY<{_CLASS}>, sourcefile: ARRAY<{_SOURCE}>>>"
_ENTRY = f"struct<path: string, details: struct<lines: {COV_RECORDS['lines']}, funcs: {COV_RECORDS['funcs']}>>"
_METHODS = "struct<name: string, line: bigint, calls: bigint>"


def _entry(package: Column, source: Column) -> Column:
    name = text_or_empty(source["_name"])
    package_name = text_or_empty(package["_name"])
    lines = F.transform(
        source["line"],
        lambda x: facts.line_struct(
            parse_int(x["_nr"]),
            ((parse_int_or_zero(x["_ci"]) > 0) | (parse_int_or_zero(x["_cb"]) > 0)).cast("bigint"),
        ),
    )
    classes = F.filter(package["class"], lambda c: text_or_empty(c["_sourcefilename"]) == name)
    methods = F.flatten(
        F.transform(
            classes,
            lambda c: array_or_empty(
                F.transform(
                    c["method"],
                    lambda m: facts.func_struct(
                        text_or_empty(m["_name"]), parse_int_or_zero(m["_line"]), F.lit(0).cast("bigint")
                    ),
                ),
                _METHODS,
            ),
        )
    )
    path = F.when(package_name != "", slash_join(package_name, name)).otherwise(name)
    return F.struct(
        path.alias("path"),
        let(
            F.filter(lines, lambda x: x["line"].isNotNull()),
            lambda found: F.struct(found.alias("lines"), methods_called(methods, found).alias("funcs")),
        ).alias("details"),
    )


def methods_called(methods: Column, lines: Column) -> Column:
    """calls = 1 for a method declared on a covered line of its file, else 0."""
    left = F.transform(
        methods,
        lambda m, i: F.struct(F.when(m["line"] > 0, m["line"]).alias("key"), i.alias("pos"), m["name"].alias("name"), m["line"].alias("line")),
    )
    covered = F.filter(lines, lambda x: x["hits"] > 0)
    right = F.transform(covered, lambda x, i: F.struct(x["line"].alias("key"), i.alias("pos"), F.lit(1).cast("bigint").alias("value")))
    return F.transform(
        with_last(left, right),
        lambda x: facts.func_struct(x["item"]["name"], x["item"]["line"], F.coalesce(x["value"], F.lit(0).cast("bigint"))),
    )


def _entries(doc: Column) -> Column:
    return F.flatten(
        F.transform(
            doc["package"],
            lambda p: array_or_empty(F.transform(p["sourcefile"], lambda s: _entry(p, s)), _ENTRY),
        )
    )


def jacoco_func_calls(funcs: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """calls = 1 for a method declared on a covered line of its file, else 0. For tables; a file's own are matched in its row."""
    covered = (
        lines.where((F.col("hits") > 0) & (F.col("line") > 0))
        .select(*keys, "line")
        .distinct()
        .withColumn("covered", F.lit(1).cast("bigint"))
    )
    return (
        attach(funcs.drop("calls"), covered, [*keys, "line"])
        .withColumn("calls", F.coalesce("covered", F.lit(0).cast("bigint")))
        .drop("covered")
    )


def ingest_jacoco(spark: SparkSession, inputs: Artifacts) -> facts.CoverageFacts:
    """One entry per source file; a line is hit when any instruction or branch is."""
    docs = scan_documents(spark, inputs)
    rows, rejected = exploded_entries(docs, _SCHEMA, "report", _entries, "jacoco")
    rows = rows.select("*", "entry.path", "entry.details.*").drop("entry")
    records = rows.withColumn("branches", F.lit(None).cast(COV_RECORDS["branches"]))
    return facts.coverage_facts(records, list_sources(spark, inputs), rejected)
