"""Compare a registered query with its SQL, independent of row order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return float(f"{value:.12g}") + 0.0
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def spark_bag(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), bag(df.columns, df.collect())


def sql_bag(con, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), bag(columns, result.fetchall())


def difference(con, sql: str, df) -> str | None:
    """None when equal, else a short description."""
    want_columns, want = sql_bag(con, sql)
    got_columns, got = spark_bag(df)
    if want_columns != got_columns:
        return f"columns {got_columns} != {want_columns}"
    if want == got:
        return None
    return (
        f"rows {sum(got.values())} != {sum(want.values())}; only in Spark {list((got - want).items())[:3]}; "
        f"only in SQL {list((want - got).items())[:3]}"
    )
