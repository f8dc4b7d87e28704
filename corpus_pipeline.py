"""A training corpus from `documents`: rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of `documents`;
a stage's rows are written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm import decontamination, line_dedup, quality_rules, simhash
from buildlens.llm.common import stored, table
from buildlens.llm.kept import Kept
from buildlens.llm.queries import packed, tokenizer_path


def _apart(docs: DataFrame) -> tuple[Kept, DataFrame]:
    """All columns of the documents under inner names, beside the two that operators read."""
    kept = Kept(docs.columns)
    return kept, kept.take(docs, doc_id=F.col("doc_id"), text=F.col("text"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    kept, inner = _apart(docs)
    return kept.give(quality_rules.apply_rules(inner, kept.inner).where("kept"), [])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line matches; n_chars follows the text."""
    kept, inner = _apart(docs)
    of = dict(zip(kept.names, kept.inner))
    text = line_dedup.without_lines(F.col(of["text"]), F.col("removed"))
    edited = line_dedup.deduplicate(inner, kept.inner).withColumn(of["text"], text)
    return kept.give(edited.withColumn(of["n_chars"], F.char_length(of["text"]).cast("long")), [])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id.

    Of rows with equal ids any one stays, and of a group without ids too.
    """
    kept, inner = _apart(docs)
    found = simhash.near_duplicates(inner, kept.inner)
    doc_id = F.col(dict(zip(kept.names, kept.inner))["doc_id"])
    return kept.give(found.where(doc_id.eqNullSafe(F.col("component_id"))).dropDuplicates(["root"]), [])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    kept, inner = _apart(docs)
    judged = decontamination.decontaminate(inner, table(spark, sf_dir, "benchmark"))
    return kept.give(judged.where("NOT contaminated"), [])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the kept documents and its place in a training sequence."""
    return packed(docs, tokenizer_path())


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
