"""Test results while they are being produced."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from buildlens.operators.cases import test_stats
from buildlens.sources.gotest import EVENT, TERMINAL, finished_cases

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Groups per run: enough to spread one run, few enough that calls stay rare.
BUCKETS = 64
_FINISHED = "run_id string, package string, test string, at bigint, action string, elapsed double, raw_output string"


def time_in_nanos(text: Column) -> Column:
    """Nanoseconds since 1970 of a time stamp with any number of fraction digits and any offset; null for others."""
    micros = F.unix_micros(F.try_to_timestamp(text))
    fraction = F.rpad(F.regexp_extract(text, r"\.([0-9]+)", 1), 9, "0")
    return micros * 1000 + F.substring(fraction, 7, 3).cast("bigint")


def stream_events(lines: DataFrame) -> DataFrame:
    """Events of single tests from a stream with `run_id` and `value`."""
    event = F.from_json("value", EVENT)
    return (
        lines.withColumn("event", event)
        .where((F.col("event.Test") != "") & F.col("event.Action").isin("run", "output", *TERMINAL))
        .select(
            "run_id",
            F.coalesce("event.Package", F.lit("")).alias("package"),
            F.col("event.Test").alias("test"),
            time_in_nanos(F.col("event.Time")).alias("at"),
            F.col("event.Action").alias("action"),
            F.coalesce("event.Elapsed", F.lit(0.0)).alias("elapsed"),
            F.coalesce("event.Output", F.lit("")).alias("output"),
        )
    )


class OpenTests(StatefulProcessor):
    """Output of the tests that have started and not ended.

    One call handles a bucket of tests. `pieces` holds the output of each running
    test, an empty piece if it has none yet: one write for a test and batch. Its keys
    are all that is read on every call; a piece is read when its test ends.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = "package string, test string, part int"
        self.pieces = handle.getMapState("pieces", key, "output string", ttlDurationMs=self.ttl_ms)

    def stored_parts(self) -> dict[tuple[str, str], list[int]]:
        """Numbers of the stored pieces of every running test."""
        stored: dict[tuple[str, str], list[int]] = {}
        for package, test, part in self.pieces.keys():
            stored.setdefault((package, test), []).append(part)
        return stored

    def take_stored(self, test: tuple[str, str], parts: list[int]) -> list[str]:
        """Stored output of a test in order; the state lets go of it."""
        out = []
        for part in sorted(parts):
            out.append(self.pieces.getValue((*test, part))[0])
            self.pieces.removeKey((*test, part))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable", na_position="first")
        stored = self.stored_parts()
        test = ["package", "test"]
        # Segments: the output between two markers (runs and ends) of a test; 0 comes before the first one.
        marker = batch["action"] != "output"
        batch["segment"] = marker.groupby([batch["package"], batch["test"]]).cumsum()
        pieces: dict[tuple, list[str]] = {}
        said = batch[~marker]
        for *name, output in zip(said["package"], said["test"], said["segment"], said["output"]):
            pieces.setdefault(tuple(name), []).append(output)
        text = {name: "".join(outputs) for name, outputs in pieces.items()}
        marks = batch[marker].copy()
        marks["before"] = marks.groupby(test)["action"].shift(fill_value="")
        names = list(zip(marks["package"], marks["test"], marks["segment"] - 1))
        # Output counts if a run opened its segment, or an earlier batch left the test open.
        marks["raw_output"] = [
            text.get(n, "") if opened == "run" or (n[2] == 0 and n[:2] in stored) else ""
            for n, opened in zip(names, marks["before"])
        ]
        first = marks[marks["segment"] == 1]
        for at, name in zip(first.index, zip(first["package"], first["test"])):
            if name in stored:
                marks.at[at, "raw_output"] = "".join(self.take_stored(name, stored.pop(name))) + marks.at[at, "raw_output"]
        last = marks.drop_duplicates(test, keep="last")
        still = {name: n for *name_, n, a in zip(last["package"], last["test"], last["segment"], last["action"])
                 if a == "run" for name in [tuple(name_)]}
        for name, segment in {**{name: 0 for name in stored}, **still}.items():
            piece = text.get((*name, segment), "")
            if piece or segment:
                self.pieces.updateValue((*name, max(stored.get(name, [-1])) + 1), (piece,))
        done = marks[marks["action"] != "run"].assign(run_id=key[0])
        columns = [f.split()[0] for f in _FINISHED.split(", ")]
        yield pd.DataFrame(list(zip(*(done[c].tolist() for c in columns))), columns=columns)

    def close(self) -> None:
        pass


def stream_gotest_cases(lines: DataFrame, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Cases of an endless event feed, emitted when a test ends.

    The tests of a run are spread over buckets; the state of a test goes when
    it ends, and tests that never end fall out after `ttl_ms`. The events of
    one micro-batch are put in the order of their time, so the trigger's input
    limit bounds what a bucket sorts. Needs the RocksDB state store, and with
    `ttl_ms` a trigger that keeps running.
    """
    bucket = F.pmod(F.xxhash64("package", "test"), F.lit(buckets)).cast("int")
    finished = (
        stream_events(lines)
        .withColumn("bucket", bucket)
        .groupBy("run_id", "bucket")
        .transformWithStateInPandas(
            statefulProcessor=OpenTests(ttl_ms),
            outputStructType=_FINISHED,
            outputMode="Append",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
    )
    # A stream has no file position: cases of a run are ordered by their time.
    start = F.struct(F.lit(0).alias("block_start"), F.lit(0).alias("row_id"))
    return finished_cases(
        finished.withColumns(
            {"source": F.lit("<stream>"), "source_ord": F.format_string("%020d", F.coalesce("at", F.lit(0))), "seq": start}
        )
    )


def stream_run_stats(cases: DataFrame) -> DataFrame:
    """Running totals per run; write it in update mode."""
    return test_stats(cases)
