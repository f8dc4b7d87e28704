"""Reading one page of a sorted table, or of each group of it, without sorting the table.

A deep page is found by rank selection: a sample of the sort keys proposes two keys around the
page, one scan counts the rows before and between them, and where the counts prove that the page
lies between, only those rows are sorted. Groups that are still long go through another round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.plans.skew import attach
from buildlens.session import materialize

# A sort key: an expression, and whether it descends. Together the keys of an order tell all rows apart.
Key = tuple[Column, bool]

# Pages that end within this many rows come from Spark's top-k.
TOP_K_ROWS = 10_000
# Up to so many rows of a group are sorted by one task.
SORT_ROWS = 200_000
# Keys sampled of a group for a round, and the part of its rows that they are at most.
SAMPLE_KEYS = 1 << 16
SAMPLE_SHARE = 0.05
ROUNDS = 8
_HASH_BITS = 40


def sort_columns(order: list[Key]) -> list[Column]:
    return [key.desc() if descending else key.asc() for key, descending in order]


def page(df: DataFrame, order: list[Key], number: int, size: int, top_k_rows: int = TOP_K_ROWS, sort_rows: int = SORT_ROWS) -> DataFrame:
    """Rows of one page of the whole table; a number past the end gives the last page."""
    total = df.count()
    pages = max(1, -(-total // size))
    start = (min(max(number, 1), pages) - 1) * size
    if start + size <= top_k_rows:
        return df.orderBy(*sort_columns(order)).offset(start).limit(size)
    return page_of_each(df, [], order, number, size, sort_rows)


def page_of_each(df: DataFrame, groups: list[str], order: list[Key], number: int, size: int, sort_rows: int = SORT_ROWS) -> DataFrame:
    """Rows of one page of every group, in order; a number past a group's end gives its last page."""
    names = [f"_key{i}" for i in range(len(order))]
    down = [descending for _, descending in order]
    # Null keys of a struct are equal to each other, so a null group is a group.
    group = F.struct(*groups) if groups else F.struct(F.lit(0))
    keyed = df.withColumns({"_group": group, **{n: key for n, (key, _) in zip(names, order)}})
    bounds = materialize(_found(keyed, names, down, number, size, sort_rows), "page-bounds")
    row = [F.col(n) for n in names]
    near = attach(keyed, bounds, ["_group"], "inner").where(_between(row, down, names))
    place = Window.partitionBy("_group").orderBy(*sort_columns(list(zip(row, down))))
    placed = near.withColumn("_place", F.col("_before") + F.row_number().over(place))
    on_page = placed.where((F.col("_place") > F.col("_start")) & (F.col("_place") <= F.col("_start") + size))
    return on_page.orderBy("_group", "_place").select(*df.columns)


def _less(left: list[Column], right: list[Column], down: list[bool]) -> Column:
    """Whether one key comes before another; nulls come first going up and last going down."""
    test = F.lit(False)
    for a, b, descending in reversed(list(zip(left, right, down))):
        smaller = (a > b) | (a.isNotNull() & b.isNull()) if descending else (a < b) | (a.isNull() & b.isNotNull())
        test = F.coalesce(smaller, F.lit(False)) | (a.eqNullSafe(b) & test)
    return test


def _parts(bound: str, names: list[str]) -> list[Column]:
    return [F.col(bound)[n] for n in names]


def _between(row: list[Column], down: list[bool], names: list[str], low: str = "_low", high: str = "_high") -> Column:
    above = F.col(low).isNull() | ~_less(row, _parts(low, names), down)
    below = F.col(high).isNull() | ~_less(_parts(high, names), row, down)
    return above & below


def _found(keyed: DataFrame, names: list[str], down: list[bool], number: int, size: int, sort_rows: int) -> DataFrame:
    """For each group: where its page starts, two keys around the page, the rows before and between them."""
    keys = keyed.select("_group", *names)
    row = [F.col(n) for n in names]
    key = F.struct(*names)
    none = F.lit(None).cast(keys.select(key.alias("k")).schema["k"].dataType)
    pages = F.greatest(F.ceil(F.col("_inside") / size), F.lit(1))
    start = (F.least(F.greatest(F.lit(number), F.lit(1)), pages) - 1) * size
    state = keys.groupBy("_group").agg(F.count("*").alias("_inside")).withColumns(
        {"_start": start.cast("long"), "_end": F.least((start + size).cast("long"), F.col("_inside")), "_before": F.lit(0).cast("long"), "_low": none, "_high": none}
    )
    columns = ["_group", "_start", "_end", "_before", "_inside", "_low", "_high"]
    state = materialize(state.select(*columns), "page-groups")
    done = state.where(F.col("_inside") <= sort_rows)
    long = state.where(F.col("_inside") > sort_rows)
    for _ in range(ROUNDS):
        if long.isEmpty():
            break
        share = F.least(F.lit(SAMPLE_SHARE), F.lit(float(SAMPLE_KEYS)) / F.col("_inside"))
        picked = F.pmod(F.xxhash64(*names), F.lit(1 << _HASH_BITS)) < share * float(1 << _HASH_BITS)
        sample = attach(keys, long, ["_group"], "inner").where(picked & _between(row, down, names))
        in_order = Window.partitionBy("_group").orderBy(*sort_columns(list(zip(row, down))))
        sample = sample.withColumns({"_n": F.row_number().over(in_order), "_m": F.count("*").over(Window.partitionBy("_group"))})
        margin = 2 * F.sqrt("_m") + 1
        before = F.floor((F.col("_start") - F.col("_before")) / F.col("_inside") * F.col("_m") - margin)
        behind = F.ceil((F.col("_end") - F.col("_before")) / F.col("_inside") * F.col("_m") + margin)
        around = sample.groupBy("_group").agg(
            F.max(F.when(F.col("_n") == before, key)).alias("_low2"), F.max(F.when(F.col("_n") == behind, key)).alias("_high2")
        )
        tried = materialize(
            attach(long, around, ["_group"]).withColumns({"_low2": F.coalesce("_low2", "_low"), "_high2": F.coalesce("_high2", "_high")}), "page-tries"
        )
        counts = attach(keys, tried, ["_group"], "inner").groupBy("_group").agg(
            F.count_if(F.col("_low2").isNotNull() & _less(row, _parts("_low2", names), down)).alias("_before2"),
            F.count_if(_between(row, down, names, "_low2", "_high2")).alias("_inside2"),
        )
        holds = (F.col("_before2") <= F.col("_start")) & (F.col("_before2") + F.col("_inside2") >= F.col("_end"))
        better = holds & (F.col("_inside2") < F.col("_inside"))
        judged = attach(tried, counts, ["_group"]).select(
            "_group", "_start", "_end",
            *[F.when(better, F.col(c + "2")).otherwise(F.col(c)).alias(c) for c in ("_before", "_inside", "_low", "_high")],
        )
        judged = materialize(judged, "page-round")
        done = done.unionByName(judged.where(F.col("_inside") <= sort_rows))
        long = judged.where(F.col("_inside") > sort_rows)
    return done.unionByName(long)
