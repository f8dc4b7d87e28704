"""CODEOWNERS files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.text import drop_first, trim_space
from buildlens.operators.owners import OwnerRule
from buildlens.sources.scan import artifacts, scan_artifacts


def read_owner_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_ord, pattern, owners) of a CODEOWNERS file.

    Blank lines, comments and patterns without owners are skipped.
    """
    text = trim_space(F.col("value"))
    return (
        scan_artifacts(spark, artifacts(path))
        .where((text != "") & ~text.startswith("#"))
        .withColumn("words", F.split(text, r"\s+"))
        .where(F.size("words") >= 2)
        .select(
            F.col("seq").alias("rule_ord"),
            F.col("words")[0].alias("pattern"),
            drop_first(F.col("words")).alias("owners"),
        )
    )


def owner_rules(rules: DataFrame) -> list[OwnerRule]:
    """The rules of one file, in order, as settings of a query.

    A rule file is written by hand and becomes part of the query itself.
    """
    return [OwnerRule(row["pattern"], tuple(row["owners"])) for row in rules.orderBy("rule_ord").collect()]
