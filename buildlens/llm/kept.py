"""Columns that an operator passes through, kept apart from the columns it makes."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


# Columns that operators read under these names.
READ = ("doc_id", "text")


class Kept:
    """Kept columns travel as k0, k1, …, so no name of theirs can meet an operator's own."""

    def __init__(self, names: list[str]):
        self.names = list(names)
        self.inner = [f"k{i}" for i in range(len(self.names))]

    def take(self, df: DataFrame, **read: Column) -> DataFrame:
        """The kept columns under their inner names, with the named expressions beside them."""
        kept = [named(n).alias(k) for n, k in zip(self.names, self.inner)]
        return df.select(*kept, *[expr.alias(name) for name, expr in read.items()])

    def give(self, df: DataFrame, added: list[str]) -> DataFrame:
        """The kept columns under their own names, then the added ones, which replace kept ones of the same name."""
        taken = {a.lower() for a in added}
        kept = [F.col(k).alias(n) for n, k in zip(self.names, self.inner) if n.lower() not in taken]
        return df.select(*kept, *added)


def keeping(*added: str) -> Callable:
    """For an operator with the parameters `documents` and `columns`, the columns to keep.

    The operator sees kept columns under inner names, beside the columns READ and the one that
    its parameter `path` names. The caller gets them back under their own names; one with the name
    of an `added` column is replaced by that.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(*args, **more) -> DataFrame:
            given = signature.bind(*args, **more)
            given.apply_defaults()
            values = given.arguments
            documents, kept = values["documents"], Kept(values["columns"])
            read = {c: F.col(c) for c in READ if c in documents.columns}
            if "path_column" in values and values["path_column"]:
                read["path_of_text"] = named(values["path_column"])
                values["path_column"] = "path_of_text"
            values["documents"], values["columns"] = kept.take(documents, **read), kept.inner
            return kept.give(operator(*given.args, **given.kwargs), list(added))

        return run

    return wrap
