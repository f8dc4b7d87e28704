"""Every operator as a query over the given tables, with its SQL counterpart."""

from buildlens.catalog import (  # noqa: F401
    cases,
    coverage,
    deltas,
    functions,
    inputs,
    publishing,
    roundtrips,
    streams,
)
from buildlens.catalog.base import oracle_sql, queries  # noqa: F401
