from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from buildlens.operators.cases import test_stats as stats_of
from buildlens.sources.gotest import ingest_gotest
from buildlens.sources.scan import artifacts
from buildlens.streaming.gotest import ROCKSDB, stream_gotest_cases, stream_run_stats


def event(second, action, test, **more):
    return json.dumps({"Time": f"2024-01-01T00:00:{second:02d}Z", "Action": action, "Package": "p", "Test": test, **more})


FIRST = [
    event(0, "run", "A"), event(1, "output", "A", Output="one\n"), event(0, "output", "B", Output="lost\n"),
    event(2, "run", "C"), event(4, "fail", "C", Elapsed=0.5), event(3, "output", "C", Output="late line\n"),
    "garbled", event(5, "run", "Never"),
]
SECOND = [event(10, "output", "A", Output="two\n"), event(11, "output", "Never", Output="x\n")]
THIRD = [
    event(20, "output", "A", Output="three\n"), event(21, "fail", "A"), event(22, "output", "A", Output="after\n"),
    event(23, "run", "A"), event(24, "output", "A", Output="not now"), event(25, "skip", "A"), event(26, "pass", "B"),
]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before)


def drain(df, out, state, **trigger):
    writer = df.writeStream.format("parquet").option("checkpointLocation", str(state)).outputMode("append")
    query = writer.trigger(**(trigger or {"availableNow": True})).start(str(out))
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def test_state_lives_across_batches(spark, tmp_path, rocksdb):
    feed, out, state = tmp_path / "run7", tmp_path / "out", tmp_path / "state"
    feed.mkdir()

    def lines():
        stream = spark.readStream.format("text").schema("value STRING").load(str(feed))
        return stream.withColumn("run_id", F.lit("run7"))

    for i, batch in enumerate([FIRST, SECOND, THIRD]):
        (feed / f"{i}.json").write_text("\n".join(batch))
        # Every batch is a query of its own that resumes from the checkpoint.
        drain(stream_gotest_cases(lines(), buckets=2), out, state)
    got = spark.read.parquet(str(out))
    expected = [
        ("A", "fail", "one\ntwo\nthree", 0), ("A", "skip", "not now", 0), ("B", "pass", None, 0),
        ("C", "fail", "late line", 500_000_000),
    ]
    assert rows(got, "name", "status", "message", "duration_ns") == expected

    # In file order the late line of C comes after its end; the rest is the same.
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "all.json").write_text("\n".join(FIRST + SECOND + THIRD))
    batch = rows(ingest_gotest(spark, artifacts(str(whole))).cases, "name", "status", "message", "duration_ns")
    assert batch == [e if e[0] != "C" else ("C", "fail", None, 500_000_000) for e in expected]


def test_events_are_ordered_by_time_not_by_text(spark, tmp_path, rocksdb):
    def at(stamp, action, **more):
        return json.dumps({"Time": f"2024-01-01T{stamp}", "Action": action, "Package": "p", "Test": "T", **more})

    events = [
        at("00:00:00.12Z", "output", Output="boom\n"), at("00:00:00.2Z", "fail"), at("00:00:00.123Z", "output", Output="second\n"),
        at("00:00:00.1Z", "run"), at("01:00:00.1230000015+01:00", "output", Output="third\n"),
        at("00:00:00.123000002Z", "output", Output="fourth"),
    ]
    feed = tmp_path / "in"
    feed.mkdir()
    (feed / "a.json").write_text("\n".join(events))
    stream = spark.readStream.format("text").schema("value STRING").load(str(feed)).withColumn("run_id", F.lit("r"))
    drain(stream_gotest_cases(stream, buckets=1), tmp_path / "out", tmp_path / "state")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "name", "status", "message") == [("T", "fail", "boom\nsecond\nthird\nfourth")]


def test_time_to_live_is_accepted(spark, tmp_path, rocksdb):
    feed = tmp_path / "in"
    feed.mkdir()
    (feed / "a.json").write_text("\n".join(FIRST))
    stream = spark.readStream.format("text").schema("value STRING").load(str(feed)).withColumn("run_id", F.lit("r"))
    drain(stream_gotest_cases(stream, ttl_ms=60_000, buckets=1), tmp_path / "out", tmp_path / "state", once=True)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "name", "status") == [("C", "fail")]


def test_running_totals(spark, tmp_path):
    feed = tmp_path / "cases"
    statuses = ["pass", "fail", "flaky", "skip", "pass", "fail"]
    table = spark.createDataFrame([(f"r{i % 2}", s) for i, s in enumerate(statuses)], "run_id string, status string")
    table.repartition(3).write.parquet(str(feed))
    seen = []
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", "1").parquet(str(feed))
    query = stream_run_stats(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append(df.collect()))
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) > 1
    last = {r["run_id"]: (r["total"], r["passed"], r["failed"], r["skipped"]) for batch in seen for r in batch}
    assert last == {r["run_id"]: tuple(r)[1:] for r in stats_of(table).collect()}


class _Written(dict):
    """Map state that counts its writes."""

    writes = 0

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


def test_a_running_test_is_written_once_for_a_batch():
    import pandas as pd

    from buildlens.streaming.gotest import OpenTests

    states = []

    class Handle:
        def getMapState(self, *names, **more):
            states.append(_Written())
            return states[-1]

    columns = ["package", "test", "at", "action", "elapsed", "output"]
    processor = OpenTests()
    processor.init(Handle())

    def batch(*events):
        frame = pd.DataFrame([("p", t, at, action, 0.0, out) for t, at, action, out in events], columns=columns)
        return [tuple(r) for r in next(processor.handleInputRows(("r", 0), iter([frame]), None))[["test", "raw_output"]].values]

    assert batch(("a", 1, "run", ""), ("a", 2, "output", "x"), ("a", 3, "output", "y"), ("b", 1, "run", "")) == []
    assert sum(s.writes for s in states) == 2
    assert batch(("a", 4, "output", "z"), ("b", 4, "output", "w"), ("c", 4, "output", "lost")) == []
    assert sum(s.writes for s in states) == 4
    assert batch(("a", 5, "pass", ""), ("b", 5, "output", "!"), ("b", 6, "fail", ""), ("c", 5, "fail", "")) == [
        ("a", "xyz"), ("c", ""), ("b", "w!"),
    ]
    assert not any(states)
