"""Cobertura XML documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import parse_int, parse_int_or_zero
from buildlens.functions.text import blank_to_null
from buildlens.plans.inrow import runs_by_key
from buildlens.schemas import COV_RECORDS
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, list_sources, scan_documents
from buildlens.sources.xmlcoverage import exploded_entries
from buildlens.sources.xmltext import array_or_empty, text_or_empty

_LINES = "STRUCT<line: ARRAY<STRUCT<_number: STRING, _hits: STRING>>>"
_METHOD = f"STRUCT<_name: STRING, _line: STRING, _hits: STRING, lines: {_LINES}>"
_CLASS = f"STRUCT<_name: STRING, _filename: STRING, methods: STRUCT<method: ARRAY<{_METHOD}>>, lines: {_LINES}>"
_SCHEMA = f"packages STRUCT<package: ARRAY<STRUCT<classes: STRUCT<class: ARRAY<{_CLASS}>>>>>"

_LINE_LIST = "struct<line: bigint, hits: bigint>"
_FUNC_LIST = "struct<name: string, line: bigint, calls: bigint>"


def _lines(lines: Column) -> Column:
    typed = F.transform(
        lines["line"],
        lambda x: facts.line_struct(parse_int(x["_number"]), parse_int_or_zero(x["_hits"])),
    )
    return array_or_empty(F.filter(typed, lambda x: x["line"].isNotNull()), _LINE_LIST)


def _entry(cls: Column) -> Column:
    methods = cls["methods"]["method"]
    funcs = F.transform(
        methods,
        lambda m: facts.func_struct(
            text_or_empty(m["_name"]), parse_int_or_zero(m["_line"]), parse_int_or_zero(m["_hits"])
        ),
    )
    return F.struct(
        F.coalesce(blank_to_null(cls["_filename"]), text_or_empty(cls["_name"])).alias("path"),
        array_or_empty(F.flatten(F.transform(methods, lambda m: _lines(m["lines"]))), _LINE_LIST).alias("method_lines"),
        _lines(cls["lines"]).alias("class_lines"),
        array_or_empty(funcs, _FUNC_LIST).alias("funcs"),
    )


def _entries(doc: Column) -> Column:
    packages = F.filter(doc["packages"]["package"], lambda p: p["classes"]["class"].isNotNull())
    return F.flatten(F.transform(packages, lambda p: F.transform(p["classes"]["class"], _entry)))


def class_line_dedup(method_lines: DataFrame, class_lines: DataFrame, keys: list[str]) -> DataFrame:
    """All method lines, plus each class line whose number is not there yet.

    Among equal class lines the first by `pos` wins. Both kinds go through one aggregate with
    partial sums, which has one row per (keys, line), so no line number is a hot key. For tables; a
    class's own lines are matched in its row.
    """
    nothing = F.lit(None).cast("bigint")
    both = class_lines.select(*keys, "line", "hits", F.col("pos").cast("bigint").alias("pos")).unionByName(
        method_lines.select(*keys, "line", nothing.alias("hits"), nothing.alias("pos"))
    )
    found = both.groupBy(*keys, "line").agg(
        F.min_by("hits", "pos").alias("hits"), F.count("pos").alias("of_class"), F.count(F.lit(1)).alias("all")
    )
    fresh = found.where(F.col("of_class") == F.col("all")).select(*keys, "line", "hits")
    return method_lines.select(*keys, "line", "hits").unionByName(fresh)


def lines_of_class(method_lines: Column, class_lines: Column) -> Column:
    """`class_line_dedup` within the row of a class: nothing leaves it."""

    def placed(line: Column, pos: Column) -> Column:
        return F.struct(line["line"].alias("key"), pos.cast("int").alias("pos"), line["hits"].alias("hits"))

    both = F.concat(
        F.transform(method_lines, lambda x: placed(x, F.lit(-1))), F.transform(class_lines, lambda x, i: placed(x, i))
    )
    # The first item of a number is a method's line, if there is one, else the first of the class.
    first = F.map_values(runs_by_key(both, lambda items, first, behind: items[first]))
    fresh = F.transform(F.filter(first, lambda x: x["pos"] >= 0), lambda x: facts.line_struct(x["key"], x["hits"]))
    return F.concat(method_lines, fresh)


def ingest_cobertura(spark: SparkSession, inputs: Artifacts) -> facts.CoverageFacts:
    """One entry per class element; branch attributes are not used."""
    docs = scan_documents(spark, inputs)
    rows, rejected = exploded_entries(docs, _SCHEMA, "coverage", _entries, "cobertura")
    rows = rows.select("*", "entry.*").drop("entry")
    records = rows.withColumn("lines", lines_of_class(F.col("method_lines"), F.col("class_lines"))).withColumn(
        "branches", F.lit(None).cast(COV_RECORDS["branches"])
    )
    return facts.coverage_facts(records, list_sources(spark, inputs), rejected)
