"""Column types of the warehouse tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("pass", "fail", "skip", "flaky")

# Place of a row in its source: scan block, then row number within the scan,
# then position inside the row for sources that hold many records per row.
RECORD_SEQ = "struct<block_start: bigint, row_id: bigint, pos: array<int>>"


def record_seq(seq: Column, *pos: Column) -> Column:
    """Order of a record that sits at nested positions `pos` of a scanned row."""
    return F.struct(
        seq["block_start"].alias("block_start"),
        seq["row_id"].alias("row_id"),
        F.array(*[p.cast("int") for p in pos]).cast("array<int>").alias("pos"),
    )


TEST_CASES = {
    "run_id": "string",
    "source": "string",
    "source_ord": "string",
    "suite": "string",
    "seq": RECORD_SEQ,
    "name": "string",
    "status": "string",
    "duration_ns": "bigint",
    "message": "string",
    "stdout": "string",
    "file": "string",
    "line": "int",
    "attachments": "array<string>",
}

TEST_RUNS = {
    "run_id": "string",
    "source": "string",
    "source_ord": "string",
    "ts": "timestamp",
    "duration_ns": "bigint",
}

ENTRY_KEYS = ["run_id", "source", "source_ord", "file_ord", "path"]

COV_RECORDS = {
    "run_id": "string",
    "source": "string",
    "source_ord": "string",
    "file_ord": RECORD_SEQ,
    "path": "string",
    "lines": "array<struct<line: bigint, hits: bigint>>",
    "branches": "array<struct<line: bigint, block: bigint, idx: bigint, taken: bigint>>",
    "funcs": "array<struct<name: string, line: bigint, calls: bigint>>",
}

REJECTS = {"run_id": "string", "source": "string", "format": "string", "error": "string"}


def conform(schema: dict[str, str], **values: Column) -> list[Column]:
    """Columns in table order and type; those not given are null, and so are values beyond their type."""
    unknown = set(values) - set(schema)
    if unknown:
        raise ValueError(f"not in the table: {sorted(unknown)}")

    def typed(name: str, kind: str) -> Column:
        value = values.get(name, F.lit(None))
        return value.try_cast(kind) if kind in ("int", "bigint") else value.cast(kind)

    return [typed(name, kind).alias(name) for name, kind in schema.items()]
