"""Lookups between two arrays of one row, in place of exploding both and joining the rows.

Runs of equal keys are found in sorted arrays and matched as two maps, which Spark zips by hash,
so the cost follows the arrays' lengths and nothing leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two arrays of up to this many pairs are compared item by item: maps would cost more than the pairs.
SHORT_PAIRS = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def runs_by_key(items: Column, of_run: Callable[[Column, Column, Column], Column]) -> Column:
    """Map from each `key` to of_run(items, first place, place behind the last) of its items.

    `items` is an array of structs sorted by their first field, `key`. Null keys are left out.
    """

    def starts(sorted_: Column) -> Column:
        places = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(
            places,
            lambda i: sorted_[i]["key"].isNotNull() & ((i == 0) | ~F.get(sorted_, i - 1)["key"].eqNullSafe(sorted_[i]["key"])),
        )

    def entries(sorted_: Column, first: Column) -> Column:
        behind = lambda j: F.coalesce(F.get(first, j + 1), F.size(sorted_))
        return F.map_from_entries(
            F.transform(first, lambda i, j: F.struct(sorted_[i]["key"].alias("key"), of_run(sorted_, i, behind(j)).alias("run")))
        )

    return let(F.sort_array(items), lambda sorted_: let(starts(sorted_), lambda first: entries(sorted_, first)))


def with_last(left: Column, right: Column) -> Column:
    """The items of `left` (structs key, pos, …) in order of pos, each as struct(item, value).

    value is that of the last item of `right` (structs key, pos, value) with the same key, or
    null. A null key matches nothing.
    """
    def matched(items: Column, others: Column) -> Column:
        short = F.size(items) * F.size(others) <= SHORT_PAIRS
        last = lambda: runs_by_key(others, lambda sorted_, first, behind: sorted_[behind - 1]["value"])
        return F.when(short, _compared(items, others)).otherwise(let(last(), lambda values: _zipped(items, values)))

    return let(left, lambda items: let(right, lambda others: matched(items, others)))


def _compared(left: Column, right: Column) -> Column:
    """`with_last` of short arrays: every pair is looked at."""
    def placed(item: Column) -> Column:
        last = F.array_max(F.filter(right, lambda x: x["key"] == item["key"]))
        return F.struct(item["pos"].alias("pos"), item.alias("item"), last["value"].alias("value"))

    in_order = F.sort_array(F.transform(left, placed))
    return F.transform(in_order, lambda x: F.struct(x["item"].alias("item"), x["value"].alias("value")))


def _zipped(left: Column, last: Column) -> Column:
    def placed(item: Column, value: Column) -> Column:
        return F.struct(item["pos"].alias("pos"), item.alias("item"), value.alias("value"))

    groups = runs_by_key(left, lambda items, first, behind: F.slice(items, first + 1, behind - first))
    # The zip's keys are those of both maps; keys that only the right side has hold no items.
    zipped = F.map_zip_with(groups, last, lambda key, items, value: F.transform(items, lambda item: placed(item, value)))
    held = F.flatten(F.filter(F.map_values(zipped), lambda items: items.isNotNull()))
    nothing = F.when(F.lit(False), F.get(F.map_values(last), F.lit(0)))
    alone = F.transform(F.filter(left, lambda item: item["key"].isNull()), lambda item: placed(item, nothing))
    in_order = F.sort_array(F.concat(held, alone))
    return F.transform(in_order, lambda x: F.struct(x["item"].alias("item"), x["value"].alias("value")))
