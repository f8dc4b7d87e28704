"""Attaching per-group facts to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.session import materialize

# A summary up to this many rows and this many bytes of files is sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
# Beyond it, a key with more fact rows than this is joined apart from the rest.
HOT_ROWS = 1_000_000
SALTS = 64
# Rows of a shuffle partition that one task sorts, about.
PART_ROWS = 250_000


def attach(
    facts: DataFrame,
    summary: DataFrame,
    keys: list[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a one-row-per-key summary to its facts without a hot reducer.

    The summary is stored once and its true size decides the plan: a broadcast
    while it has few rows and bytes; else the keys that hold very many fact rows (there are
    few of those) are joined apart, and the others by an ordinary shuffle.
    """
    stored = materialize(summary, "summary")
    if stored.count() <= broadcast_rows and stored_bytes(stored) <= BROADCAST_BYTES:
        return facts.join(F.broadcast(stored), keys, how)

    counts = facts.groupBy(*keys).count().where(F.col("count") > hot_rows)
    hot = materialize(counts.select(*keys), "hot-keys")
    hot_count = hot.count()
    if hot_count == 0:
        return facts.join(stored, keys, how)
    if hot_count > broadcast_rows:
        return salted_join(facts, stored, keys, how)
    of_hot = F.broadcast(hot)
    joined_hot = facts.join(of_hot, keys, "left_semi").join(
        F.broadcast(stored.join(of_hot, keys, "left_semi")), keys, how
    )
    joined_rest = facts.join(of_hot, keys, "left_anti").join(stored, keys, how)
    return joined_hot.unionByName(joined_rest)


def parts_for(rows: int, of: DataFrame) -> int:
    """Shuffle partitions for so many rows: those that are set, more where a task would sort over PART_ROWS."""
    return max(int(of.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a stored table's files, as Spark's reader measures them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def salted_join(
    facts: DataFrame, summary: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Shuffle join that splits every key into `salts` parts.

    The salt hashes the whole row, so a task that runs again after a lost
    executor sends each row to the same place.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    copies = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
