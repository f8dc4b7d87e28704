from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from buildlens.operators.coverage import TOTALS, cov_file_totals
from buildlens.schemas import ENTRY_KEYS
from buildlens.sources.clover import ingest_clover
from buildlens.sources.cobertura import class_line_dedup, ingest_cobertura, lines_of_class
from buildlens.sources.gocover import gocover_blocks, ingest_gocover
from buildlens.sources.jacoco import ingest_jacoco
from buildlens.sources import lcov
from buildlens.sources.lcov import ingest_lcov
from buildlens.sources.scan import artifacts, scan_artifacts


def totals(facts):
    files = cov_file_totals(facts.entries, facts.lines, facts.branches, facts.funcs, ENTRY_KEYS)
    return [
        (r["path"], *[r[t] for t in TOTALS])
        for r in files.orderBy("source_ord", "file_ord", "path").collect()
    ]


LCOV = """TN:unit
DA:1,1
SF:src/a.c
# SF: comment
FN:3,main
FN:9,12,helper
FN:20,idle
FNDA:1,main
FNDA:0,main
FNDA:2,12,helper
FNDA:7,undeclared
DA:3,5
DA:4,0,checksum
DA:x,1
DA:5 ,1
BRDA:3,0,0,1
BRDA:3,0,1,-
BRDA:3,0,2,0
BRDA:3,0,3
end_of_record
DA:9,9
SF:src/empty.c
end_of_record
SF:src/no_end.c
DA:1,1
SF:src/a.c
DA:1,1
end_of_record_not
DA:2,1
  end_of_record
SF:last.c
DA:1,0"""

LCOV_TOTALS = [
    ("src/a.c", 2, 1, 2, 1, 3, 1),
    ("src/empty.c", 0, 0, 0, 0, 0, 0),
    ("src/no_end.c", 1, 1, 0, 0, 0, 0),
    ("src/a.c", 2, 2, 0, 0, 0, 0),
    ("last.c", 1, 0, 0, 0, 0, 0),
]


@pytest.mark.parametrize("ending", ["\n", "\r\n", " \t\r\n"])
def test_lcov(spark, put, ending):
    folder = put({"a.info": LCOV.replace("\n", ending), "b.info": ""})
    got = ingest_lcov(spark, artifacts(folder))
    assert totals(got) == LCOV_TOTALS
    assert rows(got.funcs, "name", "line", "calls") == [("12,helper", 9, 2), ("idle", 20, 0), ("main", 3, 0)]
    assert rows(got.branches, "line", "idx", "taken") == [(3, 0, 1), (3, 1, -1), (3, 2, 0)]
    assert got.runs.count() == 2  # a file of zero bytes is an input too


def small_splits(spark, read):
    """Read with splits of 1500 bytes, so records lie across their borders."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return read()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("ending", ["\n", "\r\n", "\n  "])
def test_lcov_is_split_alike_whatever_the_line_ends(spark, put, ending):
    record = "SF:src/f{}.c\nDA:1,1\nDA:2,0\nBRDA:1,0,0,1\nFN:1,f\nFNDA:1,f\nend_of_record\n"
    text = "".join(record.format(i % 7) for i in range(400))
    inputs = artifacts(put({"big.info": text.replace("\n", ending)}))

    def read():
        rows_ = scan_artifacts(spark, inputs, lcov.RECORD_END)
        most = rows_.select(F.max(F.length("value"))).first()[0]
        return totals(ingest_lcov(spark, inputs)), rows_.rdd.getNumPartitions(), most

    got, tasks, most = small_splits(spark, read)
    assert got == [(f"src/f{i % 7}.c", 2, 1, 1, 1, 1, 1) for i in range(400)]
    assert tasks >= len(text) // 1500 and most < 200


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_lcov_terminators_inside_other_lines(spark, put, ending):
    """The word in a path, a name or another tag ends nothing; before a colon it does."""
    text = (
        "TN:x\nSF:src/end_of_record.c\nFN:1,end_of_record\nFNDA:3,end_of_record\nDA:1,1\nend_of_recording\nDA:2,0\n"
        "the end_of_record\nDA:3,1\n end_of_record :note\nDA:9,9\nSF:b.c\nDA:1,1\nend_of_record"
    )
    other = "SF:plain.c\nDA:1,1\nend_of_record\n"
    inputs = artifacts(put({"a.info": text.replace("\n", ending) * 60, "b.info": other * 3}))
    got = small_splits(spark, lambda: totals(ingest_lcov(spark, inputs)))
    # The last terminator of each copy but the last is followed by "TN:x" on its line, so it is none.
    both = [("src/end_of_record.c", 3, 2, 0, 0, 1, 1), ("b.c", 1, 1, 0, 0, 0, 0)]
    assert got == both * 60 + [("plain.c", 1, 1, 0, 0, 0, 0)] * 3


def test_functions_are_matched_in_their_row(spark, put):
    """No rows are shuffled before the totals, and repeated names keep their order."""
    text = "SF:a.c\nFN:5,g\nFN:1,f\nFN:7,f\nFN:9,h\nFNDA:1,f\nFNDA:4,g\nFNDA:2,f\nFNDA:8,z\nend_of_record\nSF:b.c\nFN:1,f\nend_of_record\n"
    got = ingest_lcov(spark, artifacts(put({"a.info": text})))
    assert [tuple(r) for r in got.funcs.select("path", "name", "line", "calls").collect()] == [
        ("a.c", "g", 5, 4), ("a.c", "f", 1, 2), ("a.c", "f", 7, 2), ("a.c", "h", 9, 0), ("b.c", "f", 1, 0),
    ]
    assert "Exchange" not in got.funcs._jdf.queryExecution().executedPlan().toString()


def test_a_record_of_very_many_functions(spark, put):
    n = 20_000
    lines = [f"FN:{i},fn{i % (n // 2)}" for i in range(n)] + [f"FNDA:{i},fn{i}" for i in range(0, n, 2)]
    got = ingest_lcov(spark, artifacts(put({"a.info": "SF:a.c\n" + "\n".join(lines) + "\nend_of_record\n"})))
    want = sum(i % (n // 2) for i in range(n) if i % (n // 2) % 2 == 0)
    assert got.funcs.agg(F.count("*"), F.sum("calls")).first()[:] == (n, want)


def test_gocover(spark, put):
    folder = put(
        {
            "c.out": "mode: set\n"
            "example.com/a.go:10.15,12.3 2 1\n"
            "example.com/a.go:12.3,14.2 1 0\n"
            "example.com/a.go:20.1,20.9 0 5\n"
            "garbage\nexample.com/a.go:x.1,2.2 1 1\nexample.com/a.go:1.1,2.2 1\n"
            "C:/win/b.go:3.1,2.1 1 1\n"
            "example.com/c.go:1.1,1.2 1 1\r\n"
        }
    )
    got = ingest_gocover(spark, artifacts(folder))
    assert totals(got) == [
        ("example.com/a.go", 6, 3, 0, 0, 0, 0),
        ("C:/win/b.go", 0, 0, 0, 0, 0, 0),
        ("example.com/c.go", 1, 1, 0, 0, 0, 0),
    ]
    assert rows(got.lines.where("path like '%a.go'"), "line", "hits") == [
        (10, 1), (11, 1), (12, 1), (13, 0), (14, 0), (20, 0),
    ]


def test_cobertura(spark, put):
    folder = put(
        {
            "c.xml": """<?xml version="1.0"?><!DOCTYPE coverage SYSTEM "http://cobertura.example/dtd">
<coverage line-rate="0.5"><packages><package name="p"><classes>
<class name="A" filename="src/a.py"><methods><method name="m" line="10" hits="3">
  <lines><line number="11" hits="1"/><line number="11" hits="0"/></lines></method></methods>
  <lines><line number="11" hits="9"/><line number="12" hits="0" branch="true" condition-coverage="50% (1/2)"/>
  <line number="12" hits="4"/><line number="x" hits="1"/></lines></class>
<class name="OnlyName"><lines/></class>
</classes></package><package name="empty"/></packages></coverage>""",
            "none.xml": "<coverage><packages/></coverage>",
            "bad.xml": "<coverage><packages>",
            "root.xml": "<other/>",
        }
    )
    got = ingest_cobertura(spark, artifacts(folder))
    assert totals(got) == [("src/a.py", 3, 1, 0, 0, 1, 1), ("OnlyName", 0, 0, 0, 0, 0, 0)]
    assert rows(got.lines, "line", "hits") == [(11, 0), (11, 1), (12, 0)]
    assert sorted(r["source"].rsplit("/", 1)[1] for r in got.rejects.collect()) == ["bad.xml", "root.xml"]


def test_clover(spark, put):
    folder = put(
        {
            "clover.xml": """<coverage clover="3.2"><project>
<package name="pkg"><file name="b.php"><line num="1" type="stmt" count="2"/><line num="2" type="cond" count="0"
 truecount="1" falsecount="0"/><line num="3" type="method" count="1"/><metrics statements="9"/></file>
<file name="c.php" path="/abs/c.php"><metrics statements="4" coveredstatements="3"/></file></package>
<file name="top.php"><line num="1" type="stmt" count="0"/></file>
<file name="none.php"/></project></coverage>"""
        }
    )
    got = ingest_clover(spark, artifacts(folder))
    assert totals(got) == [
        ("top.php", 1, 0, 0, 0, 0, 0),
        ("none.php", 0, 0, 0, 0, 0, 0),
        ("pkg/b.php", 2, 1, 0, 0, 1, 1),
        ("/abs/c.php", 4, 3, 0, 0, 0, 0),
    ]


def test_jacoco(spark, put):
    folder = put(
        {
            "j.xml": """<?xml version="1.0"?><!DOCTYPE report PUBLIC "-//JACOCO//DTD" "report.dtd">
<report name="jacoco"><package name="com/x"><class name="com/x/A" sourcefilename="A.java">
<method name="run" line="5"/><method name="idle" line="7"/><method name="gone"/></class>
<class name="com/x/A$B" sourcefilename="A.java"><method name="in" line="6"/></class>
<sourcefile name="A.java"><line nr="5" ci="1" cb="0"/><line nr="6" ci="0" cb="2"/><line nr="7" ci="0" cb="0"/>
<line nr="bad" ci="1"/></sourcefile></package>
<package name=""><sourcefile name="Root.java"/></package></report>"""
        }
    )
    got = ingest_jacoco(spark, artifacts(folder))
    assert totals(got) == [("com/x/A.java", 3, 2, 0, 0, 4, 2), ("Root.java", 0, 0, 0, 0, 0, 0)]
    assert rows(got.funcs, "name", "line", "calls") == [("gone", 0, 0), ("idle", 7, 0), ("in", 6, 1), ("run", 5, 1)]


def test_strip_prefix(spark, put):
    folder = put({"a.info": "SF:/ci/src/a.c\nDA:1,1\nend_of_record\nSF:/cisrc/b.c\nend_of_record\n"})
    facts = ingest_lcov(spark, artifacts(folder))
    for prefix in ("/ci", "/ci/"):
        assert [t[0] for t in totals(facts.with_prefix_stripped(prefix))] == ["src/a.c", "/cisrc/b.c"]
    assert [t[0] for t in totals(facts.with_prefix_stripped(""))] == ["/ci/src/a.c", "/cisrc/b.c"]


def test_lines_of_a_class_in_its_row_equal_those_of_tables(spark):
    draw = random.Random(7)

    def some():
        return [(draw.randint(1, 5), draw.randint(0, 9)) for _ in range(draw.randint(0, 6))]

    kind = "array<struct<line: bigint, hits: bigint>>"
    df = spark.createDataFrame([(i, some(), some()) for i in range(60)], f"id int, m {kind}, c {kind}").cache()
    got = df.select("id", F.inline(lines_of_class(F.col("m"), F.col("c"))))
    of_class = df.select("id", F.posexplode("c").alias("pos", "l")).select("id", "pos", "l.line", "l.hits")
    want = class_line_dedup(df.select("id", F.inline("m")), of_class, ["id"])
    assert rows(got, "id", "line", "hits") == rows(want, "id", "line", "hits")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_profile_line_is_taken_apart_once(spark):
    lines = spark.createDataFrame(
        [("r", "s", "s", (0, i), v) for i, v in enumerate([" a:b.go:3.1,5.2 1  7 ", "mode: set", "a.go:1.1,2.2 1", "a.go:x.1,2.2 1 1", "a.go:1.1 1 1", "a", ":1.1,2.2 0 4", ""])],
        "run_id string, source string, source_ord string, seq struct<block_start: bigint, row_id: bigint>, value string",
    )
    blocks = gocover_blocks(lines)
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("\\s+") == 1
    assert rows(blocks, "path", "start", "end", "statements", "count") == [("", 1, 2, 0, 4), ("a:b.go", 3, 5, 1, 7)]


def test_lcov_tags_and_values_with_any_white_space(spark):
    lines = ["DA:1,2", " DA :1,2", "\u00a0FN\u2003: 3,f\u00a0", "BRDA", "FNDA:", ":x", "", "\u00e9:\u00e9 \u3000", "DA:\u20031,2:3\r"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    got = df.select("i", lcov._tagged(lcov._trimmed(F.col("x"))).alias("t")).orderBy("i").collect()
    parts = [x.strip().partition(":") for x in lines]
    assert [(r.t.tag, r.t.value) for r in got] == [(tag.strip(), value.strip()) for tag, _, value in parts]


def test_documents_of_many_entries_are_spread(spark, monkeypatch):
    from buildlens.sources import xmlcoverage

    monkeypatch.setattr(xmlcoverage, "PART_ROWS", 10)
    monkeypatch.setattr(xmlcoverage, "parts_for", lambda rows, of: -(-rows // 10))
    docs = spark.range(12, numPartitions=1).selectExpr("concat('s', id) AS source", "sequence(1, 5) AS entries")
    docs = docs.union(docs.selectExpr("'broken'", "CAST(NULL AS array<int>)").limit(1))
    spread = xmlcoverage.spread_documents(docs)
    assert spread.rdd.getNumPartitions() == 6 and sorted(spread.collect()) == sorted(docs.collect())
    few = docs.limit(2)
    assert xmlcoverage.spread_documents(few) is few
