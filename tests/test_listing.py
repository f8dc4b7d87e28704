from __future__ import annotations

import os

import pytest
from conftest import rows

from buildlens.operators.cases import test_stats as stats_of
from buildlens.sources import ingest, listing, registry
from buildlens.sources.ingest import ingest_coverage, ingest_tests
from buildlens.sources.registry import COVERAGE, TESTS
from buildlens.sources.scan import artifacts, scan_heads


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "run a/x.tap": "ok 1", "run a/deep/er/y.tap": "", "run b/z+%20é.tap": "ok 1 - z", "top.tap": "ok 1\nok 2",
        "run a/_hidden.tap": "ok", "run a/.crc": "ok", "_temporary/t.tap": "ok", "k=_v/_p=1/w.tap": "ok 1",
        "run a/part._COPYING_": "x",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(tmp_path)


def names(df, root):
    return {r["source"].removeprefix(root): r["size"] for r in df.collect()}


WANT = {
    "/run a/x.tap": 4, "/run a/deep/er/y.tap": 0, "/run b/z+%20é.tap": 8, "/top.tap": 9, "/k=_v/_p=1/w.tap": 4,
}


@pytest.mark.parametrize("entries", [0, 2, 4096])
def test_listing_a_tree(spark, tree, monkeypatch, entries):
    monkeypatch.setattr(listing, "DRIVER_ENTRIES", entries)
    assert names(listing.list_files(spark, [tree]), tree) == WANT
    assert names(listing.list_files(spark, [tree + "/run*", tree + "/top.tap"]), tree) == {
        k: v for k, v in WANT.items() if "=" not in k
    }
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, [tree + "/nothing*"])


def test_listing_where_only_hadoop_reaches(spark, tree, monkeypatch):
    monkeypatch.setattr(listing, "reachable", lambda path: False)
    got = {k.removeprefix("file:").removeprefix(tree): v for k, v in names(listing.list_files(spark, [tree]), tree).items()}
    assert got == WANT


class Counted:
    """A file system that counts the bytes asked of it."""

    def __init__(self):
        self.asked = 0

    def open_input_file(self, path):
        import contextlib

        counter = self

        class File:
            def read(self, n):
                counter.asked += n
                with open(path, "rb") as f:
                    return f.read(n)

        return contextlib.nullcontext(File())


def test_only_the_head_of_a_file_is_read(spark, put, monkeypatch):
    folder = put({"small": "TN:\nSF:a"})
    large = os.path.join(folder, "large.log")
    with open(large, "wb") as f:
        f.write(b"mode: set\n")
        f.truncate(40 << 30)  # zeros up to 40 GB, which no reader would get through
    counted = Counted()
    monkeypatch.setattr(listing, "file_system", lambda path: (counted, path, ""))
    assert len(listing.first_bytes(large, 512)) == 512 and counted.asked == 512
    monkeypatch.undo()
    heads = {r["source"]: r for r in scan_heads(spark, artifacts(folder), []).collect()}
    assert len(heads[large]["head"]) == 512 and heads[large]["size"] == 40 << 30
    found = registry.detect_artifacts(spark, artifacts(folder), COVERAGE)
    assert sorted(r["format"] for r in found.collect()) == ["gocover", "lcov"]


def test_heads_are_bytes(spark, put):
    folder = put({"bin": "é\x00\r\nx", "exact": "a" * 512, "long": "b" * 513})
    got = {r["source"].rsplit("/", 1)[1]: r["head"] for r in scan_heads(spark, artifacts(folder), []).collect()}
    assert got == {"bin": "é\x00\r\nx".encode().decode("latin-1"), "exact": "a" * 512, "long": "b" * 512}


def test_streamed_heads_agree(spark, put, monkeypatch):
    folder = put({"a": "1..3\nok 1", "b": "x\n" * 600, "c.tap": "ok", "d": ""})
    want = {r["source"]: (r["head"], r["size"]) for r in scan_heads(spark, artifacts(folder), ["tap"]).collect()}
    monkeypatch.setattr("buildlens.sources.scan.reachable", lambda path: False)
    got = {r["source"]: (r["head"].rstrip("\n"), r["size"]) for r in scan_heads(spark, artifacts(folder), ["tap"]).collect()}
    assert got == {k: (h.rstrip("\n"), n) for k, (h, n) in want.items()} and len(got) == 4


LINES = {"tap": TESTS, "gotest": TESTS, "junit": TESTS, "lcov": COVERAGE, "gocover": COVERAGE}
DOCUMENTS = {"nunit": TESTS, "cucumber": TESTS, "cobertura": COVERAGE, "clover": COVERAGE, "jacoco": COVERAGE}


@pytest.mark.parametrize("fmt", [*LINES, *DOCUMENTS])
def test_files_of_zero_bytes(spark, put, fmt):
    """Formats without a frame accept one and have nothing in it; a document may not be empty."""
    folder = put({"none": ""})
    kind = (LINES | DOCUMENTS)[fmt]
    got = (ingest_tests if kind == TESTS else ingest_coverage)(spark, artifacts(folder), fmt=fmt)
    bad = [r["source"].rsplit("/", 1)[1] for r in got.rejects.collect()]
    if fmt in LINES:
        assert bad == [] and [r["source"].rsplit("/", 1)[1] for r in got.runs.collect()] == ["none"]
    else:
        assert bad == ["none"]


def test_an_empty_run_beside_a_full_one(spark, put):
    inputs = artifacts(put({"a.tap": ""}, "empty"), put({"b.tap": "ok 1 - b", "c.tap": ""}, "full"))
    got = ingest_tests(spark, inputs)
    assert rows(stats_of(got.cases, runs=got.runs), "run_id", "total") == [("empty", 0), ("full", 1)]
    assert got.runs.count() == 3 and got.rejects.count() == 0


def test_many_files_are_picked_by_table(spark, put, monkeypatch):
    """Beyond the number that a reader is told by name, results stay the same."""
    files = {
        "a.xml": '<testsuite><testcase name="x" classname="S"/></testsuite>', "c.tap": "1..2\nok 1 a\nnot ok 2 b", "empty.tap": "",
        "b.json": '{"Action":"run","Package":"p","Test":"T"}\n{"Action":"fail","Package":"p","Test":"T"}',
        "d.log": '<test-run><test-suite name="N"><test-case name="n" result="Passed"/></test-suite></test-run>',
        "e": '[{"uri":"u","elements":[{"name":"s","steps":[{"result":{"status":"skipped"}}]}]}]', "f.bin": "?",
    }
    folder = put(files)

    def tables():
        got = ingest_tests(spark, artifacts(folder))
        return (
            rows(got.cases, "name", "status", "suite"), rows(got.runs, "run_id", "source", "duration_ns"), rows(got.rejects, "source", "error"),
        )

    want = tables()
    assert len(want[0]) == 6 and len(want[1]) == 6 and len(want[2]) == 1
    monkeypatch.setattr(ingest, "NAMED_FILES", 0)
    assert tables() == want
