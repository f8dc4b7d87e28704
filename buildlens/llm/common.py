"""Helpers shared by the operators: row keys, Arrow chunks, components, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from buildlens.session import materialize

# White space of the word contracts: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A Python task handles so many characters at once, or one text if it is longer.
CHUNK_CHARS = 1_000_000
# A table that was stored and measured below this many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table, written once to the shared folder; lost executors do not recompute it."""
    return materialize(df, f"llm-{label}")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and every other character kept; `lower` does just that where all are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words_of(text: Column, breaks: str) -> Column:
    """Maximal runs of characters outside the class `breaks`; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{breaks}]+"), "")


def map_chunks(
    df: DataFrame, keep: list[str], read: list[str], run: Callable[..., dict[str, object]], added: str
) -> DataFrame:
    """`keep` columns of every row with the `added` ones (a DDL schema) that `run` makes.

    `run` gets the `read` columns of a chunk of rows as lists, the text first, and returns the
    added columns. With an entry `_row` it gives any number of rows: the input row of each.
    Rows stay in their partition, and kept columns stay in Arrow whatever their type.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields
    schema = StructType([*kept, *StructType.fromDDL(added).fields])
    target = to_arrow_schema(schema)
    names = [f"k{i}" for i in range(len(keep))] + [f"r{i}" for i in range(len(read))]
    picked = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip([*keep, *read], names)])
    n = len(keep)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, n):
                out = run(*[piece.column(i).to_pylist() for i in range(n, piece.num_columns)])
                row = out.pop("_row", None)
                columns = [piece.column(i) if row is None else piece.column(i).take(pa.array(row, pa.int64())) for i in range(n)]
                for field in list(target)[n:]:
                    values = out[field.name]
                    if not isinstance(values, pa.Array):
                        values = pa.array(values, type=None if isinstance(values, np.ndarray) else field.type)
                    columns.append(values if values.type == field.type else values.cast(field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return picked.mapInArrow(over, schema)


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_CHARS bytes of the text column; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    first, size = 0, 0
    for i, n in enumerate(sizes):
        if i > first and size + n > CHUNK_CHARS:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield batch.slice(first)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) can reach.

    Large-star and small-star rounds: every round hangs a node's neighbours on its
    smallest one, so each link is replaced, never multiplied, and the number of
    rounds grows with the logarithm of a component's size. Each round is stored.
    """
    links = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    before = None
    while True:
        state = _state(links)
        if state == before or state[0] == 0:
            break
        before = state
        links = stored(_small_star(_large_star(links)), label)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return (row[0], row[1])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def smallest(df: DataFrame, by: str, bound: int) -> DataFrame:
    """At most `bound` rows of a stored table: all, or those with the smallest hashes in column `by`.

    The table is counted first and thinned by hash to little more than `bound` rows, so no
    more than that is ever sorted or sent anywhere.
    """
    rows = df.count()
    if rows <= bound:
        return df
    low = F.pmod(F.col(by), F.lit(1 << 40))
    share = 1.2 * bound / rows + 100 / rows
    return df.where(low < F.lit(int(min(1.0, share) * (1 << 40)))).orderBy(low, by).limit(bound)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table's files, as Spark's reader measures them, hold at most `limit` bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit
