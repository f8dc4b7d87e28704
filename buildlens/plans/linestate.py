"""Running state over the lines of a file.

A reader that remembers "the last marker line" becomes a window. One window per
file would put a giant file on one task, so lines are cut into chunks of at most
2**chunk_bits rows: the window runs inside a chunk, and one summary row per
chunk carries the marker across chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 18


def chunk_number(seq: str = "seq", chunk_bits: int = CHUNK_BITS) -> Column:
    """Chunk of a line: its scan block, and its row range inside the scan."""
    return F.struct(
        F.col(f"{seq}.block_start").alias("block_start"),
        F.shiftright(F.col(f"{seq}.row_id"), chunk_bits).alias("part"),
    )


def neighbour_markers(
    df: DataFrame, keys: list[str], marker: str, seq: str = "seq", chunk_bits: int = CHUNK_BITS, parts: int | None = None
) -> DataFrame:
    """Add `prev_marker` and `next_marker`.

    They are the nearest non-null values of `marker` strictly before and
    strictly after each row, among the rows with equal `keys`. With `parts` the chunks are
    spread over so many tasks.
    """
    lines = df.withColumn("_chunk", chunk_number(seq, chunk_bits))
    chunk_keys = [*keys, "_chunk"]
    if parts:
        lines = lines.repartition(parts, *chunk_keys)
    inside = Window.partitionBy(*chunk_keys)
    before = inside.orderBy(F.col(seq).asc()).rowsBetween(Window.unboundedPreceding, -1)
    after = inside.orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, -1)

    is_marker = F.col(marker).isNotNull()
    at = F.when(is_marker, F.col(seq))
    summary = lines.groupBy(*chunk_keys).agg(
        F.max_by(marker, at).alias("_chunk_last"), F.min_by(marker, at).alias("_chunk_first")
    )
    across = Window.partitionBy(*keys)
    earlier = across.orderBy(F.col("_chunk").asc()).rowsBetween(Window.unboundedPreceding, -1)
    later = across.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *chunk_keys,
        F.last("_chunk_last", ignorenulls=True).over(earlier).alias("_carry_prev"),
        F.last("_chunk_first", ignorenulls=True).over(later).alias("_carry_next"),
    )
    local = lines.withColumn("_prev", F.last(marker, ignorenulls=True).over(before)).withColumn(
        "_next", F.last(marker, ignorenulls=True).over(after)
    )
    # One summary row meets one bounded chunk, so the join has no hot key.
    return (
        local.join(carried, chunk_keys)
        .withColumn("prev_marker", F.coalesce("_prev", "_carry_prev"))
        .withColumn("next_marker", F.coalesce("_next", "_carry_next"))
        .drop("_chunk", "_prev", "_next", "_carry_prev", "_carry_next")
    )
