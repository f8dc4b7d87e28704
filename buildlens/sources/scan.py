"""Opening artifacts: splittable lines, whole documents and file heads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.functions.text import file_extension
from buildlens.plans.skew import attach
from buildlens.sources.listing import list_files, plain_name, reachable, read_heads, read_texts

# Fixed value: bytes looked at to recognise a format.
SNIFF_BYTES = 512


@dataclass(frozen=True)
class Artifacts:
    """A set of input files.

    `run_id` maps the file path to its run; by default the folder the file lies
    in. Sources of a run are ordered by path. `only`, a table (source, size), leaves
    just these of the files that the paths name.
    """

    paths: tuple[str, ...]
    run_id: Column | None = None
    only: DataFrame | None = None

    def run_of(self, path: Column) -> Column:
        if self.run_id is not None:
            return self.run_id
        return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def artifacts(*paths: str, run_id: Column | None = None) -> Artifacts:
    return Artifacts(tuple(paths), run_id)


def source_path() -> Column:
    """Decoded path of the file a row was read from; local paths lose their URI scheme."""
    escaped = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(escaped), r"^file:(//)?(?=/)", "")


def chosen(df: DataFrame, inputs: Artifacts) -> DataFrame:
    """Rows (with `source`) of the wanted files."""
    if inputs.only is None:
        return df
    return attach(df, inputs.only.select("source"), ["source"], "left_semi")


def _in_runs(df: DataFrame, inputs: Artifacts) -> DataFrame:
    return df.withColumn("run_id", inputs.run_of(F.col("source"))).withColumn("source_ord", F.col("source"))


def _identified(df: DataFrame, inputs: Artifacts, *columns: Column) -> DataFrame:
    return _in_runs(chosen(df.select(source_path().alias("source"), *columns), inputs), inputs)


def scan_artifacts(spark: SparkSession, inputs: Artifacts, line_sep: str = "\n") -> DataFrame:
    """Lines of every file, with `seq` restoring their order inside the file.

    Files are split between tasks, so one huge file is read in parallel.
    `line_sep` other than the line feed makes each row one record.
    """
    lines = spark.read.text(list(inputs.paths), lineSep=line_sep, recursiveFileLookup=True)
    seq = F.struct(
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    return _identified(lines, inputs, F.col("value"), seq.alias("seq"))


def scan_documents(spark: SparkSession, inputs: Artifacts) -> DataFrame:
    """One row per file with its whole text; files of zero bytes have an empty one."""
    listed = sized_sources(spark, inputs)
    if inputs.only is not None and all(reachable(plain_name(p)) for p in inputs.paths):
        return read_texts(listed.drop("size"))
    texts = spark.read.text(list(inputs.paths), wholetext=True, recursiveFileLookup=True)
    empty = listed.where("size = 0").drop("size").withColumn("value", F.lit(""))
    return _identified(texts, inputs, F.col("value")).unionByName(empty)


def _has_extension(name: Column, extensions: list[str]) -> Column:
    if not extensions:
        return F.lit(False)
    return F.lower(name).rlike(r"\.(" + "|".join(extensions) + r")$")


def scan_heads(spark: SparkSession, inputs: Artifacts, known_extensions: list[str]) -> DataFrame:
    """Extension, size and first bytes of every file.

    The head stays empty where the extension already decides the format: those
    files are never opened. Of the others no more than the head is read.
    """
    listed = sized_sources(spark, inputs).withColumn("extension", file_extension(F.col("source")))
    known = _has_extension(F.col("source"), known_extensions)
    decided = listed.where(known | (F.col("size") == 0)).withColumn("head", F.lit(""))
    unknown = listed.where(~known & (F.col("size") > 0))
    if all(reachable(plain_name(p)) for p in inputs.paths):
        return decided.unionByName(read_heads(unknown, SNIFF_BYTES))
    streamed = chosen(_streamed_heads(spark, inputs, known_extensions), inputs)
    return decided.unionByName(unknown.join(streamed, "source"))


def _streamed_heads(spark: SparkSession, inputs: Artifacts, known_extensions: list[str]) -> DataFrame:
    """(source, head) where only Spark's readers reach the files: the first lines of each leave the scan."""
    lines = spark.read.text(list(inputs.paths), lineSep="\n", recursiveFileLookup=True)
    opened = lines.where(
        ~_has_extension(F.col("_metadata.file_name"), known_extensions)
        & (F.col("_metadata.file_block_start") == 0)
    ).select(
        source_path().alias("source"),
        F.monotonically_increasing_id().alias("row_id"),
        F.substring(F.encode("value", "UTF-8"), 1, SNIFF_BYTES).alias("start"),
    )
    # A line has at least its line feed, so this many lines hold all the bytes.
    place = F.row_number().over(Window.partitionBy("source").orderBy("row_id"))
    first = opened.withColumn("place", place).where(F.col("place") <= SNIFF_BYTES)
    in_order = F.array_sort(F.collect_list(F.struct("place", F.decode("start", "ISO-8859-1").alias("text"))))
    head = F.array_join(F.transform(in_order, lambda x: x["text"]), "\n")
    return first.groupBy("source").agg(F.substring(head, 1, SNIFF_BYTES).alias("head"))


def sized_sources(spark: SparkSession, inputs: Artifacts) -> DataFrame:
    """(run_id, source, source_ord, size) of every file, without opening any; empty files too."""
    files = list_files(spark, list(inputs.paths)) if inputs.only is None else inputs.only.select("source", "size")
    return _in_runs(files, inputs)


def list_sources(spark: SparkSession, inputs: Artifacts) -> DataFrame:
    """(run_id, source, source_ord) of every file."""
    return sized_sources(spark, inputs).drop("size")
