from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from buildlens.operators import cases, coverage, deltas, gates, merge, owners
from buildlens.operators.owners import OwnerRule, assign_owners, tag_failures_with_owners
from buildlens.sources.owners import owner_rules, read_owner_rules

CASE = "run_id string, source string, suite string, name string, seq bigint, status string, duration_ns bigint, message string, file string, line int"


def make_cases(spark, *data):
    full = [
        (run, src, suite, name, i, status, ms * 10**6, None, None, None)
        for i, (run, src, suite, name, status, ms) in enumerate(data)
    ]
    return spark.createDataFrame(full, CASE)


def test_stats_count_flaky_as_passed(spark):
    df = make_cases(spark, *[("r", "s", "S", str(i), st, 1) for i, st in enumerate(["pass", "flaky", "fail", "skip", "pass"])])
    stats = cases.with_status_pcts(cases.test_stats(df)).first()
    assert (stats["total"], stats["passed"], stats["failed"], stats["skipped"], stats["pass_pct"]) == (5, 3, 1, 1, 60.0)
    assert cases.flaky_count(df).first()["flaky"] == 1


def test_collapse_retries_against_brute_force(spark):
    rng = random.Random(2)
    data = [
        ("r", f"s{rng.randint(0, 1)}", f"S{rng.randint(0, 1)}", f"t{rng.randint(0, 5)}", rng.choice(["pass", "fail", "skip"]), i)
        for i in range(80)
    ]
    groups: dict = {}
    for i, row in enumerate(data):
        groups.setdefault(row[:4], []).append((i, row[4], row[5]))
    want = set()
    for key, members in groups.items():
        statuses = {m[1] for m in members}
        place = members[0][0]
        if len(members) > 1 and {"pass", "fail"} <= statuses:
            best = [m for m in members if m[1] == "pass"][-1]
            want.add((*key, place, "flaky", best[2]))
        else:
            want.add((*key, place, members[0][1], members[0][2]))
    got = {
        (r["run_id"], r["source"], r["suite"], r["name"], r["seq"], r["status"], r["duration_ns"] // 10**6)
        for r in cases.collapse_retries(make_cases(spark, *data)).collect()
    }
    assert got == want


def test_slow_marks_and_filters(spark):
    df = make_cases(
        spark, ("a", "s", "Pkg.One", "x", "pass", 3000), ("a", "s", "Pkg.One", "y", "fail", 300),
        ("a", "s", "Pkg.Two", "Zed", "skip", 299), ("b", "s", "Pkg.Two", "x", "pass", 90), ("b", "s", "q", "w", "pass", 100),
    )
    marked = cases.mark_slow(df)
    assert rows(marked.where("slow"), "run_id", "name") == [("a", "x"), ("a", "y"), ("b", "w")]
    # The longest case of the rows shown decides.
    assert rows(cases.mark_slow(cases.filter_status(df, "skip")).where("slow"), "name") == [("Zed",)]
    assert cases.search_cases(df, " pkg.TWO ").count() == 2
    assert cases.search_cases(df, "zed").count() == 1
    assert cases.search_cases(df, "").count() == 5
    assert cases.filter_status(df, "all").count() == 5
    with pytest.raises(ValueError):
        cases.filter_status(df, "odd")


def test_locale_sort(spark):
    df = make_cases(spark, *[("r", "s", s, "n", "pass", 1) for s in ("b", "a", "B", "ä", "A", "z")])
    assert [r["suite"] for r in cases.sort_cases(df, "suite").collect()] == ["a", "A", "ä", "b", "B", "z"]
    assert [r["suite"] for r in cases.sort_cases(df, "suite", descending=True).collect()][0] == "z"


COV_LINE = "run_id string, path string, line bigint, hits bigint"


def files(spark, *data):
    """(run, source, file_ord, path, lines_total, lines_covered)"""
    return spark.createDataFrame(
        [(*row, 0, 0, 0, 0) for row in data],
        "run_id string, source_ord string, file_ord bigint, path string, lines_total bigint, lines_covered bigint, "
        "branch_total bigint, branch_covered bigint, func_total bigint, func_covered bigint",
    )


def test_file_totals(spark):
    lines = spark.createDataFrame([("r", "a", 1, 5), ("r", "a", 2, 0), ("r", "a", 2, 7)], COV_LINE)
    branches = spark.createDataFrame([("r", "a", t) for t in (1, 0, -1)] + [("r", "u", -1)], "run_id string, path string, taken bigint")
    funcs = spark.createDataFrame([("r", "a", 0), ("r", "a", 3)], "run_id string, path string, calls bigint")
    entries = spark.createDataFrame([("r", "a"), ("r", "u"), ("r", "empty")], "run_id string, path string")
    got = coverage.cov_file_totals(entries, lines, branches, funcs, ["run_id", "path"])
    assert rows(got, "path", *coverage.TOTALS) == [
        ("a", 3, 2, 2, 1, 2, 1), ("empty", 0, 0, 0, 0, 0, 0), ("u", 0, 0, 0, 0, 0, 0),
    ]
    stats = coverage.cov_stats(got).first()
    assert (stats["line_pct"], stats["branch_pct"], stats["func_pct"], stats["file_count"]) == (2 / 3 * 100, 50.0, 50.0, 3)


def test_bands_and_thresholds_with_empty_files(spark):
    df = files(
        spark, ("r", "s", 0, "a/none.go", 0, 0), ("r", "s", 1, "a/zero.go", 10, 0), ("r", "s", 2, "low.go", 10, 4),
        ("r", "s", 3, "b/warn.go", 10, 5), ("r", "s", 4, "b/good.go", 10, 8),
    )
    view = coverage.cov_view_rows(df)
    bands = {b: [r[0].split("/")[-1] for r in rows(coverage.filter_coverage_band(view, b), "path")] for b in ("zero", "low", "warn")}
    assert bands == {"zero": ["zero.go"], "low": ["low.go"], "warn": ["warn.go"]}
    assert coverage.below_threshold_count(view, 50).first()["below_count"] == 3
    assert [r["path"] for r in coverage.worst_files(df, 50).collect()] == ["a/zero.go", "low.go"]
    assert [r["path"] for r in coverage.files_by_size(view).collect()] == ["a/zero.go", "b/good.go", "b/warn.go", "low.go"]
    dirs = coverage.dir_rollup(view, 50).collect()
    assert [(d["dir"], d["file_count"], d["below_count"], d["line_pct"]) for d in dirs] == [
        ("(root)", 1, 1, 40.0), ("a", 2, 2, 0.0), ("b", 2, 0, 65.0),
    ]


def test_page_status_rounds_and_gate_does_not(spark):
    # 79.996 % shows as 80.00 % on the page, and still fails the gate at 80.
    stats = coverage.cov_stats(files(spark, ("r", "s", 0, "a", 25000, 19999)))
    tests = cases.test_stats(make_cases(spark, ("r", "s", "S", "t", "pass", 1)))
    assert gates.run_status(tests, stats, 80).first()["coverage_status"] == "PASS"
    gate = {r["metric"]: r["failed"] for r in gates.coverage_gate(stats, line=80, func=10).collect()}
    assert gate == {"line": True, "branch": False, "func": True}
    assert gates.combined_gate(tests, stats, 80).first()["gate_failed"] is True
    assert gates.combined_gate(tests, stats, 0).first()["gate_failed"] is False
    nothing = coverage.cov_stats(files(spark, ("r", "s", 0, "a", 5, 0)))
    assert gates.combined_gate(tests, nothing, 0).first()["coverage_failed"] is True
    with pytest.raises(ValueError):
        gates.coverage_gate(stats, line=101)


def test_merge_rule(spark):
    df = files(
        spark,
        ("r", "1.info", 0, "a", 2, 1), ("r", "1.info", 1, "a", 3, 1), ("r", "1.info", 2, "b", 1, 1),
        ("r", "2.info", 0, "a", 2, 2), ("r", "2.info", 1, "n", 4, 0), ("r", "2.info", 2, "n", 1, 1),
        ("r", "3.info", 0, "n", 5, 5), ("q", "2.info", 0, "a", 9, 9),
    )
    got = merge.merge_cov_runs(df)
    assert rows(got, "run_id", "path", "from_first", "lines_total", "lines_covered") == [
        ("q", "a", True, 9, 9), ("r", "a", True, 2, 1), ("r", "a", True, 5, 3), ("r", "b", True, 1, 1), ("r", "n", False, 10, 6),
    ]


def test_snapshot_files_and_deltas(spark):
    base = files(spark, ("b", "s", 0, "a.go", 10, 7), ("b", "s", 1, "same.go", 4, 2), ("b", "s", 2, "gone.go", 1, 1))
    current = files(
        spark, ("c", "s", 0, "a.go", 10, 1), ("c", "s", 1, "a.go", 10, 8), ("c", "s", 2, "same.go", 2, 1), ("c", "s", 3, "new.go", 1, 1)
    )
    def shares(df):
        return deltas.snapshot_files(df).drop("run_id")

    changed = deltas.file_deltas(shares(base), shares(current), [])
    assert [(r["path"], round(r["delta"], 9)) for r in changed.collect()] == [("a.go", 10.0)]
    view = coverage.cov_view_rows(current.where("file_ord > 0"))
    assert rows(deltas.cov_rows_with_delta(view, changed), "path", F.round("delta", 6).alias("d")) == [
        ("a.go", 10.0), ("new.go", None), ("same.go", None),
    ]


def test_run_delta_needs_both_sides(spark):
    def snap(run, tests, covered):
        case_rows = make_cases(spark, *[(run, "s", "S", str(i), st, 1) for i, st in enumerate(tests)]) if tests else None
        cov = files(spark, (run, "s", 0, "a", 10, covered)) if covered is not None else None
        return deltas.build_snapshots(case_rows, cov, F.lit(None).cast("timestamp"), F.lit("")).withColumn("pair", F.lit(1))

    full = deltas.run_delta(snap("b", ["pass", "fail"], 5), snap("c", ["pass", "pass", "skip"], 4), ["pair"]).first()
    assert (full["total_delta"], full["passed_delta"], full["failed_delta"], full["skipped_delta"]) == (1, 1, -1, 1)
    assert full["line_pct_delta"] == -10.0 and full["has_tests"] and full["has_coverage"]
    half = deltas.run_delta(snap("b", None, 5), snap("c", ["pass"], 6), ["pair"]).first()
    assert not half["has_tests"] and half["has_coverage"] and half["line_pct_delta"] == 10.0


RULES = """# owners
*            @all
*.go         @go @lang
/src/d1/     @d1
docs/        @never
/exact.md    @exact
/tree/*      @tree
b/c.txt      @bc
no-owner
"""


@pytest.mark.parametrize("inline", [50, 0])
def test_owner_rules(spark, put, monkeypatch, inline):
    monkeypatch.setattr(owners, "INLINE_RULES", inline)
    folder = put({"CODEOWNERS": RULES})
    rules = owner_rules(read_owner_rules(spark, folder))
    assert rules[0] == OwnerRule("*", ("@all",)) and rules[1].owners == ("@go", "@lang") and len(rules) == 7
    paths = {
        "x.txt": "@all", "a/b.go": "@go @lang", "src/d1/x.go": "@d1", "/src/d1/x": "@d1", "src/./d1//y": "@d1",
        "src/d1": "@all", "docs/a.txt": "@all", "exact.md": "@exact", "sub/exact.md": "@all", "tree/deep/x": "@tree",
        "a/b/c.txt": "@bc", "b/c.txt": "@bc", "ab/c.txt": "@all", "src/../x.go": "@go @lang",
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: " ".join(r["owners"]) for r in assign_owners(df, rules).collect()}
    assert got == paths
    unowned = assign_owners(df, rules[2:3]).where("owners IS NULL").count()
    assert unowned == len(paths) - 3
    assert assign_owners(df, []).where("owners IS NULL").count() == len(paths)


def test_rules_by_table_equal_rules_one_by_one(spark, monkeypatch):
    rng = random.Random(8)
    words = ["a", "b", "src", "x.go", "y.test.js", ".go", "z"]
    some = [
        "*", "*.go", "*.js", "*.test.js", ".go", "a", "a/", "/a/", "/a", "/", "/*", "/a/*", "/a/b/*", "/*/b/", "/s*/*", "a/b", "b/x.go",
        "/a/x.go", "/src/*.go", "/src/a/?.go", "/src/[a-z].go", "x.*", "s?c/*.go", "[", "/a/[", "a\\*", "x.go", "*o", "*.",
    ]
    paths = ["", "/", "x.", None] + ["/".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in paths], "path string").cache()
    for seed in range(3):
        rules = [OwnerRule(p, (f"@{i}",)) for i, p in enumerate(random.Random(seed).choices(some, k=12))]
        monkeypatch.setattr(owners, "INLINE_RULES", 50)
        want = rows(assign_owners(df, rules), "path", "owners")
        monkeypatch.setattr(owners, "INLINE_RULES", 0)
        assert rows(assign_owners(df, rules), "path", "owners") == want


def test_thousands_of_rules(spark):
    """Each path meets its own few rules: 5,000 rules on 40,000 paths."""
    kinds = ["/d{0}/", "/d{0}/e/*", "/d{0}/e/f.go", "e/f{0}.go", "*.x{0}", "/d{0}/g*.go"]
    rules = [OwnerRule(kinds[i % 6].format(i), (f"@{i}",)) for i in range(5000)]
    paths = spark.range(40_000).select(F.concat(F.lit("d"), F.col("id") % 5000, F.lit("/e/f.go")).alias("path"), "id")
    got = assign_owners(paths, rules).agg(F.count("owners"), F.count("*")).first()
    assert got[:] == (8 * sum(i % 6 < 3 for i in range(5000)), 40_000)
    owned = {r["path"]: r["owners"] for r in assign_owners(paths.where("id < 12"), rules).collect()}
    assert owned["d0/e/f.go"] == ["@0"] and owned["d1/e/f.go"] == ["@1"] and owned["d2/e/f.go"] == ["@2"]
    assert owned["d3/e/f.go"] is None and owned["d6/e/f.go"] == ["@6"]


def test_globs_of_a_table_mean_what_they_mean_in_an_expression(spark, monkeypatch):
    draw = random.Random(5)
    signs = ["*", "*", "?", "[ab]", "[^a]", "[a-c]", "[c-a]", "[^b-a]", "[/]", "[", "[]", "\\\\*", "\\\\", "[\\\\]]", "[a]", "a", "b", ".", "/", "-", "[.-]"]
    paths = ["".join(draw.choices("aab/.*-]", k=draw.randint(1, 7))) for _ in range(150)] + ["a*/b", "/", "", "a?/*/b", "b[a", "aab/aab/aab.b"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for _ in range(4):
        globs = ["".join(draw.choices(signs, k=draw.randint(1, 5))) for _ in range(40)]
        globs = [draw.choice(["", "", "/", "/a"]) + g + draw.choice(["", "", "/", "/*"]) for g in globs]
        rules = [OwnerRule(g, (f"@{i}",)) for i, g in enumerate(globs)]
        monkeypatch.setattr(owners, "INLINE_RULES", 50)
        want = rows(assign_owners(df, rules), "path", "owners")
        monkeypatch.setattr(owners, "INLINE_RULES", 0)
        assert rows(assign_owners(df, rules), "path", "owners") == want


def test_plan_does_not_grow_with_the_globs_of_a_table(spark):
    paths = spark.range(400).selectExpr("concat('src/d', id % 20, '/f', id, '.go') AS path")

    def owned(count: int):
        rules = spark.range(count).selectExpr(
            "id AS rule_ord", "CASE WHEN id % 2 = 0 THEN concat('f', id, '*') ELSE concat('/src/*/f', id, '.g?') END AS pattern",
            "array(concat('@', id)) AS owners",
        )
        return assign_owners(paths, rules.unionByName(spark.sql("SELECT 0L AS rule_ord, CAST(NULL AS STRING) AS pattern, array('@none') AS owners")))

    few, many = owned(6), owned(3000)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(many) == size(few)
    got = {r["path"]: r["owners"] for r in many.collect()}
    assert got["src/d3/f3.go"] == ["@3"] and got["src/d12/f12.go"] == ["@12"] and got["src/d3/f43.go"] == ["@43"]


def test_failures_name_their_owners(spark):
    data = [
        ("fail", "a.go", "boom"), ("fail", None, None), ("pass", "a.go", "m"), ("fail", "x.rs", "m"), ("fail", "a.go", ""),
    ]
    df = spark.createDataFrame(
        [("r", "s", "suite.go", f"t{i}", i, st, 0, msg, f, None) for i, (st, f, msg) in enumerate(data)], CASE
    )
    got = tag_failures_with_owners(df, [OwnerRule("*.go", ("@a", "@b"))]).orderBy("seq").collect()
    assert [r["message"] for r in got] == ["[@a @b] boom", "[owners: @a @b]", "m", "m", "[owners: @a @b]"]


def test_attachments(spark):
    df = spark.createDataFrame(
        [("r", "s", "n", ["a/b.JPEG", "c\\log.txt", "data:image/x", "dir/"])],
        "run_id string, suite string, name string, attachments array<string>",
    )
    assert [(r["kind"], r["label"]) for r in cases.attachment_rows(df).collect()] == [
        ("image", None), ("link", "log.txt"), ("image", None), ("link", "attachment"),
    ]
