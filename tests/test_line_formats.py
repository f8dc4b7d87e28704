from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from buildlens.sources.gotest import ingest_gotest
from buildlens.sources.scan import artifacts
from buildlens.sources.tap import ingest_tap


def event(action, test="T", package="p", **more):
    return json.dumps({"Action": action, "Package": package, "Test": test, **more})


def test_gotest_state_machine(spark, put):
    long_line = "x" * 2049
    lines = [
        json.dumps({"Action": "start", "Package": "p"}),
        event("output", "A", Output="before run\n"),
        event("run", "A"),
        event("output", "A", Output="=== RUN   A\n"),
        event("output", "B", Output="lost\n"),
        event("output", "A", Output="    crate holds 7 of 9\n"),
        "not json at all",
        event("output", "A", Output="--- FAIL: A (0.5s)\n"),
        event("fail", "A", Elapsed=0.5),
        event("output", "A", Output="after\n"),
        event("run", "A"),
        event("output", "A", Output="old run\n"),
        event("run", "A"),
        event("output", "A", Output="    t.Skip(\"belt is down\")\n"),
        event("skip", "A", Elapsed=0.1),
        event("run", "Long"),
        event("output", "Long", Output=long_line),
        event("fail", "Long"),
        event("run", "Multi"),
        event("output", "Multi", Output="é" * 2000),
        event("fail", "Multi"),
        event("pass", "P", package="", Elapsed=0.25),
        event("run", "Never"),
        json.dumps({"Action": "pass", "Package": "p"}),
    ]
    folder = put({"go.json": "\n".join(lines) + "\n"})
    for bits in (18, 1):
        got = ingest_gotest(spark, artifacts(folder), chunk_bits=bits)
        assert rows(got.cases, "suite", "name", "status", "duration_ns", "message") == [
            ("default", "P", "pass", 250_000_000, None),
            ("p", "A", "fail", 500_000_000, "crate holds 7 of 9"),
            ("p", "A", "skip", 100_000_000, 't.Skip("belt is down")'),
            ("p", "Long", "fail", 0, "x" * 2048 + "\n…"),
            ("p", "Multi", "fail", 0, "é" * 1024 + "\n…"),
        ]
        stdout = got.cases.where("status = 'fail' and name = 'A'").first()["stdout"]
        assert stdout == "=== RUN   A\n    crate holds 7 of 9\n--- FAIL: A (0.5s)"
        assert rows(got.runs, "duration_ns") == [(500_000_000,)]


TAP = """TAP version 13
1..11
ok 1 - passes # time=1.5
not ok 2 - breaks # lid is open
  ---
  not ok 99 - inside yaml
  ---
  ...
ok 3 - skipped # SKIP waits for parts
ok 4
not ok 5 - todo # TODO later
    ok 6 - indented
not ok 7 a # b # c
ok 8 - sum # time=2.0 #
not ok 9 # skip wins
...
ok 10 plain
---
ok 11 - swallowed
"""

TAP_CASES = [
    ("a # b", "fail", 0, "c"),
    ("breaks", "fail", 0, "lid is open"),
    ("passes", "pass", 1_500_000_000, None),
    ("plain", "pass", 0, None),
    ("skipped", "skip", 0, "waits for parts"),
    ("sum", "pass", 2_000_000_000, None),
    ("test", "pass", 0, None),
    ("test", "skip", 0, "wins"),
    ("todo", "fail", 0, "TODO later"),
]


@pytest.mark.parametrize("bits", [18, 0, 1])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_tap(spark, put, bits, ending):
    folder = put({"x.tap": TAP.replace("\n", ending)})
    got = ingest_tap(spark, artifacts(folder), chunk_bits=bits)
    assert rows(got.cases, "name", "status", "duration_ns", "message") == TAP_CASES
    assert got.cases.first()["suite"] == folder + "/x.tap"
    assert rows(got.runs, "duration_ns") == [(3_500_000_000,)]


def test_tap_split_scan_equals_whole_scan(spark, put):
    block = "ok 1 - a # time=1\n  ---\nnot ok 2 - hidden\n  ...\nnot ok 3 - b # why\n"
    folder = put({"big.tap": block * 400})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = ingest_tap(spark, artifacts(folder), chunk_bits=3)
        counts = {r["status"]: r["count"] for r in got.cases.groupBy("status").count().collect()}
        assert got.cases.select(F.countDistinct("seq.block_start")).first()[0] > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert counts == {"pass": 400, "fail": 400}
