"""LCOV tracefiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import parse_int, parse_int_or_zero
from buildlens.functions.text import drop_first, trim_space
from buildlens.plans.inrow import with_last
from buildlens.plans.linestate import neighbour_markers
from buildlens.plans.skew import attach
from buildlens.schemas import ENTRY_KEYS, REJECTS, record_seq
from buildlens.session import materialize
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, list_sources, scan_artifacts

# The scan is cut where this text stands, so a row is a record however its lines end. Where it is
# not a line of its own (part of a path, say), rows are put together again.
RECORD_END = "end_of_record"
_BLANK = r"[^\S\n]*"
_OPENING = rf"(?md)^{_BLANK}SF{_BLANK}:"
_CLOSING = rf"(?md)^{_BLANK}end_of_record{_BLANK}(:.*)?$"
# A row that was cut at a line of its own ends behind a line feed and blanks, and the next row
# begins with the rest of that line.
_CUT_BEHIND = rf"(^|\n){_BLANK}$"
_CUT_BEFORE = rf"^{_BLANK}(:[^\n]*)?(\n|$)"
_TAGS = ("DA", "BRDA", "FN", "FNDA")


def _plain(char: Column) -> Column:
    """Whether a text begins with a visible ASCII character, so trimming its start changes nothing."""
    return F.ascii(char).between(33, 126)


def _trimmed(line: Column) -> Column:
    return F.when(_plain(line) & _plain(F.substring(line, -1, 1)), line).otherwise(trim_space(line))


def _tagged(line: Column) -> Column:
    """Tag and value of a trimmed detail line."""
    tag = F.substring_index(line, ":", 1)
    value = F.substr(line, F.length(tag) + 2)
    return F.struct(
        F.when(tag.isin(*_TAGS), tag).otherwise(trim_space(tag)).alias("tag"),
        F.when(_plain(value), value).otherwise(trim_space(value)).alias("value"),
    )


def lcov_records(rows: DataFrame) -> DataFrame:
    """One row per record: its path and its trimmed detail lines.

    A record runs from `SF` to the next `end_of_record` or `SF`, or to the end
    of the input; detail lines outside a record are ignored.
    """
    pieces = drop_first(F.split("value", _OPENING, -1))
    body = F.split("piece", _CLOSING, 2)[0]
    lines = F.transform(F.split(body, "\n", -1), _trimmed)
    more = [c for c in ("behind", "before") if c in rows.columns]
    return (
        rows.select("*", F.posexplode_outer(pieces).alias("pos", "piece"))
        .withColumn("_lines", lines)
        .select(
            "run_id", "source", "source_ord", *more,
            record_seq(F.col("seq"), F.col("pos")).alias("file_ord"),
            F.col("_lines")[0].alias("path"),
            F.filter(
                drop_first(F.col("_lines")), lambda x: (x != "") & ~x.startswith("#")
            ).alias("details"),
        )
    )


def _fields(tagged: Column, tag: str, limit: int) -> Column:
    """Comma-separated values of the detail lines with this tag."""
    return F.transform(F.filter(tagged, lambda x: x["tag"] == tag), lambda x: F.split(x["value"], ",", limit))


def _called(fields: Column) -> Column:
    return F.transform(
        F.filter(fields, lambda p: F.size(p) == 2),
        lambda p: F.struct(trim_space(p[1]).alias("name"), parse_int_or_zero(p[0]).alias("number")),
    )


def parsed_records(rows: DataFrame) -> DataFrame:
    """Records with typed line, branch, function and call arrays."""
    records = lcov_records(rows).withColumn("details", F.transform("details", _tagged))
    more = [c for c in ("behind", "before") if c in rows.columns]
    da = F.transform(
        F.filter(_fields(F.col("details"), "DA", 3), lambda p: F.size(p) >= 2),
        lambda p: facts.line_struct(parse_int(p[0]), parse_int(p[1])),
    )
    brda = F.transform(
        F.filter(_fields(F.col("details"), "BRDA", 4), lambda p: F.size(p) == 4),
        lambda p: F.struct(
            parse_int_or_zero(p[0]).alias("line"),
            parse_int_or_zero(p[1]).alias("block"),
            parse_int_or_zero(p[2]).alias("idx"),
            F.when(p[3] == "-", F.lit(-1)).otherwise(parse_int_or_zero(p[3])).cast("bigint").alias("taken"),
        ),
    )
    return records.select(
        *ENTRY_KEYS, *more,
        F.filter(da, lambda x: x["line"].isNotNull() & x["hits"].isNotNull()).alias("lines"),
        brda.alias("branches"),
        functions_called(_called(_fields(F.col("details"), "FN", 2)), _called(_fields(F.col("details"), "FNDA", 2))).alias("funcs"),
    )


def functions_called(declared: Column, calls: Column) -> Column:
    """Declared functions of a record with the number of their last call line; 0 without one."""
    left = F.transform(declared, lambda d, i: F.struct(d["name"].alias("key"), i.alias("pos"), d["number"].alias("line")))
    right = F.transform(calls, lambda c, i: F.struct(c["name"].alias("key"), i.alias("pos"), c["number"].alias("value")))
    return F.transform(
        with_last(left, right),
        lambda x: facts.func_struct(x["item"]["key"], x["item"]["line"], F.coalesce(x["value"], F.lit(0).cast("bigint"))),
    )


def lcov_func_calls(declared: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Declared functions with the hits of their last call line; 0 without one.

    Both sides have `keys` and `name`; `calls` has `pos` and `hits`. Calls of
    undeclared functions are dropped. For tables; a record's own are matched in its row.
    """
    last = calls.groupBy(*keys, "name").agg(F.max_by("hits", "pos").alias("hits"))
    return (
        attach(declared, last, [*keys, "name"])
        .withColumn("calls", F.coalesce("hits", F.lit(0).cast("bigint")))
        .drop("hits")
    )


def cut_rows(rows: DataFrame) -> DataFrame:
    """Rows of the scan, with whether the cut `behind` and `before` each looks like a terminator line's."""
    return rows.withColumn("behind", F.col("value").rlike(_CUT_BEHIND)).withColumn("before", F.col("value").rlike(_CUT_BEFORE))


def miscut_sources(records: DataFrame) -> DataFrame:
    """Sources with a cut that no terminator line made: one behind a row that is not the last, or before one not the first."""
    at = F.col("file_ord")
    place = F.struct(at["block_start"].alias("block_start"), at["row_id"].alias("row_id"))
    return (
        records.select("source", place.alias("at"), "behind", "before").groupBy("source")
        .agg(
            F.min("at").alias("first"), F.max("at").alias("last"),
            F.min(F.when(~F.col("behind"), F.col("at"))).alias("open"), F.max(F.when(~F.col("before"), F.col("at"))).alias("inside"),
        )
        .where((F.col("open") < F.col("last")) | (F.col("inside") > F.col("first"))).select("source")
    )


def rejoined(rows: DataFrame) -> DataFrame:
    """`rows` of miscut sources with the pieces of a record in one row again.

    A row goes on with the record of the row before unless the cut between them is a terminator
    line. The neighbour and the record's first row are found over chunks, as any line state is.
    """
    keys = ["run_id", "source", "source_ord"]
    flags = rows.select(*keys, "seq", "before", F.struct("behind").alias("mark"))
    placed = neighbour_markers(flags, keys, "mark").withColumn("prev_behind", F.col("prev_marker.behind"))
    opens = F.col("prev_behind").isNull() | (F.col("prev_behind") & F.col("before"))
    started = placed.select(*keys, "seq", F.when(opens, F.struct("seq")).alias("start"))
    found = neighbour_markers(started, keys, "start").select(
        *keys, "seq", F.coalesce(F.col("start.seq"), F.col("prev_marker.seq")).alias("start")
    )
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
    joined = rows.join(found, [*keys, "seq"]).groupBy(*keys, "start").agg(F.array_join(pieces, RECORD_END).alias("value"))
    return joined.withColumnRenamed("start", "seq")


def ingest_lcov(spark: SparkSession, inputs: Artifacts) -> facts.CoverageFacts:
    """Read records in parallel from any number of files of any size, whatever their line ends."""
    rows = cut_rows(scan_artifacts(spark, inputs, RECORD_END))
    found = materialize(parsed_records(rows), "lcov")
    miscut = materialize(miscut_sources(found), "lcov-miscut")
    records = found.where(F.col("path").isNotNull()).drop("behind", "before")
    if not miscut.isEmpty():
        again = materialize(attach(rows, miscut, ["source"], "left_semi"), "lcov-rows")
        mended = materialize(parsed_records(rejoined(again)).where(F.col("path").isNotNull()), "lcov-mended")
        records = attach(records, miscut, ["source"], "left_anti").unionByName(mended)
    return facts.coverage_facts(records, list_sources(spark, inputs), facts.no_rows(rows, REJECTS))
