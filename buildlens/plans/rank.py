"""Ranks in a total order over a whole table, without gathering it in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.session import materialize

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits


def numbered(df: DataFrame, name: str = "place", label: str = "ranges") -> DataFrame:
    """Every row with its place (from 1) in the order that the DataFrame has.

    The rows are written once, with the number of their partition and their number in it, so
    places stay the same when executors are lost later. Only the sizes of the partitions come
    to the driver.
    """
    marked = df.withColumn("_range", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    )
    stored = materialize(marked, label)
    before, offsets = 0, []
    for row in stored.groupBy("_range").count().orderBy("_range").collect():  # one row per partition
        offsets.append((row["_range"], before))
        before += row["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    place = (F.col("_before") + F.col("_row") + 1).alias(name)
    return stored.join(F.broadcast(starts), "_range").select(*df.columns, place)


def ranked(df: DataFrame, order: list[Column], name: str = "rank", label: str = "ranges") -> DataFrame:
    """Every row with its place (from 1) in the order, as column `name`.

    Rows that the order does not tell apart get different places, as if by chance.
    """
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name, label)
