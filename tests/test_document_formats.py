from __future__ import annotations

import json

from conftest import rows

from buildlens.sources.cucumber import ingest_cucumber
from buildlens.sources.nunit import ingest_nunit
from buildlens.sources.scan import artifacts


def ordered(facts):
    columns = ("suite", "name", "status", "duration_ns", "message")
    return [tuple(r[c] for c in columns) for r in facts.cases.orderBy("source_ord", "seq").collect()]


def test_nunit3(spark, put):
    folder = put(
        {
            "n.xml": """<test-run><test-suite name="asm"><test-suite name="Outer">
<test-case name="a" fullname="x.a" result="Passed" duration="0.25"/>
<test-suite name="Inner"><test-case name="b" result="Failed" duration="1"><failure><message> no </message>
<stack-trace>at x</stack-trace></failure></test-case></test-suite>
<test-case name="c" result="Skipped"><reason><message>later</message></reason></test-case>
</test-suite></test-suite><test-suite name="Empty"/><test-suite name="Z">
<test-case name="d" result="ERROR" duration=""/></test-suite></test-run>"""
        }
    )
    got = ingest_nunit(spark, artifacts(folder))
    assert ordered(got) == [
        ("Outer", "a", "pass", 250_000_000, None),
        ("Outer", "c", "skip", 0, "later"),
        ("Inner", "b", "fail", 1_000_000_000, "no \nat x"),
        ("Z", "d", "fail", 0, None),
    ]


def test_suites_nest_as_deep_as_they_like(spark, put):
    def nested(levels):
        inner = '<test-case name="t" result="Passed"/>'
        for i in range(levels):
            inner = f'<test-suite name="s{i}">{inner}</test-suite>'
        return f"<test-run>{inner}</test-run>"

    hidden = "<test-run><!-- <test-suite> --><test-suite name='x>y'/>" + nested(2)[len("<test-run>"):]
    folder = put({"ok.xml": nested(3), "deep.xml": nested(12), "hidden.xml": hidden, "bad.xml": "<test-run><test-suite>"})
    got = ingest_nunit(spark, artifacts(folder))
    assert rows(got.cases, "suite", "name") == [("s0", "t")] * 3
    assert [r["source"].rsplit("/", 1)[1] for r in got.rejects.collect()] == ["bad.xml"]


def test_one_deep_document_beside_many_flat_ones(spark, put):
    """The plan does not grow with the depth."""

    def document(levels):
        inner = '<test-case name="t" result="Passed" duration="1"/>'
        for i in range(levels):
            inner = f'<test-suite name="s{i}">{inner}<test-case name="c{i}" result="Failed"/></test-suite>'
        return f"<test-run>{inner}</test-run>"

    flat = put({f"{i}.xml": document(1) for i in range(300)}, "flat")
    alone = ingest_nunit(spark, artifacts(flat))
    both = ingest_nunit(spark, artifacts(flat, put({"deep.xml": document(500)}, "deep")))
    assert both.cases.where("run_id = 'flat'").count() == alone.cases.count() == 600
    deep = [(r.suite, r.name) for r in both.cases.where("run_id = 'deep'").orderBy("seq").collect()]
    assert deep == [(f"s{i}", f"c{i}") for i in range(499, 0, -1)] + [("s0", "t"), ("s0", "c0")]
    plans = [len(x.cases._jdf.queryExecution().optimizedPlan().toString()) for x in (alone, both)]
    assert abs(plans[0] - plans[1]) < 0.05 * plans[0]


def test_nunit_markup(spark, put):
    """Comments, CDATA, prefixes, entities, elements between suites and their cases."""
    document = """<?xml version="1.0"?><!DOCTYPE x><n:test-run xmlns:n="u"><!-- <test-suite name="no"> -->
<n:test-suite name="A &amp; &quot;B&quot; a/&gt;b" note='x/>y'><n:test-case name='it&apos;s' result="Failed">
<failure><message><![CDATA[<test-case name="in text"> & </test-suite> <!-- kept -->]]></message><stack-trace/></failure>
</n:test-case><wrap><n:test-suite name="hidden"><n:test-case name="lost"/></n:test-suite></wrap>
<test-suite name="In"><properties><property name="p"/><test-case name="lost too"/></properties><test-case name="z" result="Passed"></test-case>
</test-suite></n:test-suite><test-case name="of the root"/><test-suites/></n:test-run>"""
    bad_time = '<test-run><test-suite name="s"><test-case name="t" duration="soon"/></test-suite></test-run>'
    lost_time = bad_time.replace("<test-case", "<w><test-case").replace("</test-suite>", "</w></test-suite>")
    got = ingest_nunit(spark, artifacts(put({"a.xml": document, "b.xml": bad_time, "c.xml": lost_time, "d.xml": ""})))
    assert ordered(got) == [
        ('A & "B" a/>b', "it's", "fail", 0, '<test-case name="in text"> & </test-suite> <!-- kept -->'), ("In", "z", "pass", 0, None),
    ]
    assert rows(got.rejects.selectExpr("substring_index(source, '/', -1) AS file"), "file") == [("b.xml",), ("d.xml",)]
    assert got.runs.count() == 2


def test_nunit2_and_xunit(spark, put):
    folder = put(
        {
            "n2.xml": """<test-results><test-suite name="S"><results><test-case name="lost" result="Success"/></results>
<test-case name="a" result="Success" time="3"/></test-suite></test-results>""",
            "x.xml": """<assemblies><assembly name="A.dll"><collection name="C">
<test name="C.one" method="one" result="Pass" time="0.5"/><test name="C.two" result="Fail">
<failure><message>m</message></failure></test></collection><collection>
<test name="three" result="Skip"><reason>why</reason></test></collection></assembly></assemblies>""",
        }
    )
    got = ingest_nunit(spark, artifacts(folder))
    assert ordered(got) == [
        ("S", "a", "pass", 0, None),
        ("C", "C.one", "pass", 500_000_000, None),
        ("C", "C.two", "fail", 0, "m"),
        ("A.dll", "three", "skip", 0, None),
    ]
    assert got.rejects.count() == 0


def test_cucumber(spark, put):
    def step(status, duration=None, error=None):
        result = {"status": status}
        if duration is not None:
            result["duration"] = duration
        if error is not None:
            result["error_message"] = error
        return {"name": "s", "result": result}

    features = [
        {
            "name": "Login",
            "uri": "login.feature",
            "elements": [
                {"name": "bg", "type": "background", "steps": [step("failed")]},
                {"name": "ok", "type": "scenario", "steps": [step("passed", 5), step("PASSED", 7)]},
                {"name": "bad", "steps": [step("skipped"), step("failed", 1, "e1"), step("Failed", 2, "e2")]},
                {"name": "todo", "type": "scenario", "steps": [step("undefined"), step("passed", 3)]},
                {"name": "none", "type": "scenario"},
            ],
        },
        {"uri": "empty.feature"},
        {"uri": "u.feature", "elements": [{"name": "x", "type": "scenario", "steps": []}]},
    ]
    folder = put({"c.json": json.dumps(features, indent=1), "bad.json": "[{", "object.json": "{}"})
    got = ingest_cucumber(spark, artifacts(folder))
    assert ordered(got) == [
        ("Login", "ok", "pass", 12, None),
        ("Login", "bad", "fail", 3, "e1\ne2"),
        ("Login", "todo", "skip", 3, None),
        ("Login", "none", "pass", 0, None),
        ("u.feature", "x", "pass", 0, None),
    ]
    assert got.rejects.count() == 2


def test_cucumber_durations_are_whole_numbers(spark, put):
    def document(duration):
        return '[{"name": "F", "elements": [{"name": "e", "steps": [{"result": {"status": "passed", "duration": %s}}]}]}]' % duration

    good = {"none.json": ("null", 0), "zero.json": ("0", 0), "low.json": ("-3", -3), "high.json": ("9223372036854775807", 2**63 - 1)}
    bad = {"float.json": "1.5", "whole.json": "2.0", "power.json": "1e3", "text.json": '"5"', "wide.json": "9223372036854775808", "list.json": "[1]"}
    background = document("0.5").replace('"name": "e"', '"type": "background"')
    files = {k: document(v[0]) for k, v in good.items()} | {k: document(v) for k, v in bad.items()} | {"background.json": background}
    got = ingest_cucumber(spark, artifacts(put(files)))
    name = "substring_index(source, '/', -1) AS file"
    assert rows(got.cases.selectExpr(name, "duration_ns"), "file", "duration_ns") == sorted((k, v[1]) for k, v in good.items())
    assert rows(got.rejects.selectExpr(name, "error"), "file", "error") == sorted(
        (k, "duration is no whole number") for k in [*bad, "background.json"]
    )
    assert got.runs.count() == len(good)
