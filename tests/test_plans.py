from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from buildlens.plans.inrow import with_last
from buildlens.plans.linestate import neighbour_markers
from buildlens.plans.rank import numbered, ranked
from buildlens.plans.paging import page, page_of_each, sort_columns
from buildlens.plans.skew import attach, salted_join


@pytest.fixture
def facts(spark):
    return spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id").alias("v"),
    )


@pytest.mark.parametrize("how", ["left", "left_anti"])
@pytest.mark.parametrize(
    "limits", [{}, {"broadcast_rows": 5}, {"broadcast_rows": 5, "hot_rows": 100}, {"broadcast_rows": 0, "hot_rows": 1}]
)
def test_attach_equals_a_plain_join(facts, how, limits):
    summary = facts.where("k <> 'k7'").groupBy("k").agg(F.max("v").alias("top"))
    got = attach(facts, summary, ["k"], how=how, **limits)
    want = facts.join(summary, ["k"], how)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_salted_join_spreads_a_hot_key(facts):
    summary = facts.groupBy("k").agg(F.max("v").alias("top"))
    joined = salted_join(facts, summary, ["k"], salts=8)
    assert joined.count() == facts.count()
    assert joined.where("top IS NULL").count() == 0


@pytest.mark.parametrize("top_k_rows", [10**6, 0])
@pytest.mark.parametrize("number, first, last", [(1, 0, 199), (4, 600, 799), (10, 1800, 1999), (99, 1800, 1999), (0, 0, 199)])
def test_pages(facts, top_k_rows, number, first, last):
    got = [r["v"] for r in page(facts, [(F.col("v"), False)], number, 200, top_k_rows).collect()]
    assert got == list(range(first, last + 1))


def test_pages_of_short_and_empty_tables(facts):
    short = facts.where("v < 3")
    for top_k_rows in (10**6, 0):
        assert page(short, [(F.col("v"), True)], 5, 2, top_k_rows).count() == 1
        assert page(facts.where("v < 0"), [(F.col("v"), False)], 1, 10, top_k_rows).count() == 0


@pytest.mark.parametrize("sort_rows", [10**6, 300])
@pytest.mark.parametrize("number", [1, 3, 40, 10**6])
def test_pages_of_groups(spark, number, sort_rows):
    """Groups of 1 to 6,000 rows, one of them null; keys with nulls, ties and a descending part."""
    rng = random.Random(9)
    table = [
        (g, rng.choice([None, rng.randint(0, 5), rng.random() * 1000]), rng.choice(["a", "B", None]), i)
        for g, n in ((None, 700), ("one", 1), ("big", 6000), ("c", 101)) for i in range(n)
    ]
    table = [(g, None if v is None else float(v), s, i) for g, v, s, i in table]
    df = spark.createDataFrame(table, "g string, v double, s string, i int").repartition(5)
    order = [(F.col("v"), True), (F.col("s"), False), (F.col("i"), True)]
    got = [tuple(r) for r in page_of_each(df, ["g"], order, number, 50, sort_rows).collect()]
    want = []
    for g in (None, "big", "c", "one"):
        mine = sorted(
            (t for t in table if t[0] == g), key=lambda t: (t[1] is None, -(t[1] or 0), t[2] is not None, t[2] or "", -t[3])
        )
        start = (min(number, -(-len(mine) // 50)) - 1) * 50
        want += mine[start : start + 50]
    assert got == want


def test_a_deep_page_sorts_few_rows(spark, monkeypatch):
    """Rounds narrow a long group down to the rows around the page."""
    from buildlens.plans import paging

    seen = []
    keep = paging.materialize
    monkeypatch.setattr(paging, "materialize", lambda df, label: seen.append(keep(df, label)) or seen[-1])
    df = spark.range(300_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"), "id")
    order = [(F.col("v"), False), (F.col("id"), False)]
    got = [r["id"] for r in page(df, order, 1000, 200, sort_rows=3000).collect()]
    assert got == [r["id"] for r in df.orderBy(*sort_columns(order)).offset(199_800).limit(200).collect()]
    bounds = seen[-1].first()
    assert bounds["_inside"] <= 3000 and bounds["_before"] <= 199_800


def test_places_follow_the_order_of_the_table(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    assert numbered(df.orderBy("v")).where("place <> v + 1").count() == 0
    assert numbered(df).where("place <> v + 1").count() > 0


@pytest.mark.parametrize("bits", [0, 1, 3, 20])
def test_neighbour_markers_against_brute_force(spark, bits):
    rng = random.Random(3)
    data = [
        (f"k{rng.randint(0, 2)}", block, block * 100 + row, f"m{block}-{row}" if rng.random() < 0.2 else None)
        for block in range(4)
        for row in range(60)
    ]
    df = spark.createDataFrame(data, "k string, b bigint, r bigint, marker string").select(
        "k", F.struct(F.col("b").alias("block_start"), F.col("r").alias("row_id")).alias("seq"), "marker"
    )
    got = {
        r["seq"]["row_id"]: (r["prev_marker"], r["next_marker"])
        for r in neighbour_markers(df, ["k"], "marker", chunk_bits=bits).collect()
    }
    assert len(got) == len(data)
    for i, (k, _, row, _) in enumerate(data):
        before = [m for kk, _, _, m in data[:i] if kk == k and m]
        after = [m for kk, _, _, m in data[i + 1 :] if kk == k and m]
        assert got[row] == (before[-1] if before else None, after[0] if after else None)


def test_ranks_over_a_whole_table(spark):
    rng = random.Random(5)
    values = [(i, rng.choice([None, 1.5, 2.0, rng.random()]), rng.choice("ab")) for i in range(3000)]
    df = spark.createDataFrame(values, "i int, v double, s string").repartition(6)
    got = {r.i: r.place for r in ranked(df, [F.desc("v"), F.asc("s"), F.asc("i")], "place").collect()}
    order = sorted(values, key=lambda t: (t[1] is None, -(t[1] or 0), t[2], t[0]))
    assert got == {t[0]: n for n, t in enumerate(order, 1)}
    assert ranked(df.limit(0), [F.asc("i")]).count() == 0


def test_lookups_within_a_row(spark):
    rng = random.Random(2)
    table = []
    for i in range(200):
        left = [(rng.choice(["a", "b", "c", "d", None]), p) for p in range(rng.randint(0, 6))]
        right = [(rng.choice(["a", "b", "x"]), p, rng.randint(0, 99)) for p in range(rng.randint(0, 6))]
        table.append((i, left, right))
    df = spark.createDataFrame(table, "i int, l array<struct<key: string, pos: int>>, r array<struct<key: string, pos: int, value: int>>")
    got = {r.i: [(x.item.key, x.item.pos, x.value) for x in r.m] for r in df.select("i", with_last(F.col("l"), F.col("r")).alias("m")).collect()}
    for i, left, right in table:
        last = {k: v for k, _, v in right}
        assert got[i] == [(k, p, last.get(k)) for k, p in left]


def test_lookups_of_long_and_short_arrays_agree(spark, monkeypatch):
    from buildlens.plans import inrow

    rng = random.Random(3)
    table = []
    for i in range(40):
        left = [(rng.choice([1, 2, 3, 9, None]), p) for p in range(rng.randint(0, 30))]
        right = [(rng.choice([1, 2, 3, 4, None]), rng.randint(0, 5), rng.choice([7, 8, None])) for _ in range(rng.randint(0, 30))]
        table.append((i, rng.sample(left, len(left)), right))
    table += [(40, None, [(1, 0, 1)]), (41, [(1, 0)], None)]
    df = spark.createDataFrame(table, "i int, l array<struct<key: bigint, pos: int>>, r array<struct<key: bigint, pos: int, value: int>>")

    def found(pairs: int) -> list:
        monkeypatch.setattr(inrow, "SHORT_PAIRS", pairs)
        return df.select("i", with_last(F.col("l"), F.col("r")).alias("m")).orderBy("i").collect()

    assert found(10_000)[:40] == found(-1)[:40]


def test_windows_over_lines_spread_with_the_rows(spark):
    from buildlens.plans.skew import PART_ROWS, parts_for
    from buildlens.sources.nunit import nested_cases

    few = spark.range(5)
    assert parts_for(0, few) == parts_for(PART_ROWS, few) == 4
    assert parts_for(100 * PART_ROWS, few) == 100
    lines = spark.range(50).selectExpr("'s' AS source", "struct(0L AS block_start, id AS row_id) AS seq", "IF(id % 7 = 0, id, NULL) AS mark")
    pieces = few.selectExpr("'r' AS run_id", "CAST(id AS STRING) AS source", "'s' AS source_ord", "CAST(id AS INT) AS pos", "concat('<a', id, '>') AS text")
    wide = neighbour_markers(lines, ["source"], "mark", chunk_bits=3, parts=37)
    for df in (wide, nested_cases(pieces, 37)):
        assert ", 37)" in df._jdf.queryExecution().executedPlan().toString()
    got = {r.seq.row_id: (r.prev_marker, r.next_marker) for r in wide.collect()}
    assert got == {i: ((i - 1) // 7 * 7 if i else None, i // 7 * 7 + 7 if i < 49 else None) for i in range(50)}
