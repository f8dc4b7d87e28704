from __future__ import annotations

import random
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from buildlens.functions import globs, numbers, text


def apply(spark, values, kind, *columns):
    """Values next to the given columns over `x`, in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    got = df.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1] if len(columns) == 1 else tuple(r)[1:] for r in got]


def test_fixed_rounds_the_exact_binary_value(spark):
    rng = random.Random(5)
    values = [c / t * 100 for t in range(1, 130) for c in range(0, t + 1, max(1, t // 9))]
    values += [0.25, 0.35, 6.75, 26.25, 0.05, 99.95, 100.0, 1e-9, 0.15, 2.675, 1.005, 33.125, -2.25, -0.04]
    values += [rng.uniform(-100, 100) for _ in range(500)]

    def exact(x, digits, rounding):
        return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding))

    x = F.col("x")
    got = apply(spark, values, "double", numbers.fixed(x), numbers.fixed(x, 2, ties="up"))
    assert got == [(exact(v, 1, ROUND_HALF_EVEN), exact(v, 2, ROUND_HALF_UP)) for v in values]


def test_numbers(spark):
    assert apply(spark, ["1.5", "0", "-2", "x", "", "1d", "1e-3", " 1", "1e300"], "string", numbers.secs_to_ns(F.col("x"))) == [
        1_500_000_000, 0, 0, 0, 0, 0, 1_000_000, 0, 0,
    ]
    assert apply(spark, ["7", "+7", "-7", "7.0", "", "0x7", "99999999999999999999"], "string", numbers.parse_int(F.col("x"))) == [
        7, 7, -7, None, None, None, None,
    ]
    assert apply(spark, [0.0, 2.34, -1.1, 0.04], "double", numbers.fmt_pct_delta(F.col("x"))) == [
        "0.0%", "+2.3%", "-1.1%", "+0.0%",
    ]
    assert apply(spark, [3, -2, 0], "int", numbers.fmt_int_delta(F.col("x"))) == ["+3", "-2", "0"]
    assert apply(spark, [0, 1, 999, 1000, 1125, 61234], "bigint", numbers.fmt_duration_ms(F.col("x"))) == [
        "< 1ms", "1ms", "999ms", "1.00s", "1.13s", "61.23s",
    ]
    second = 10**9
    assert apply(spark, [0, 5, second, 59 * second, 125 * second], "bigint", numbers.fmt_run_duration(F.col("x"))) == [
        "–", "0s", "1s", "59s", "2m 5s",
    ]
    bands = apply(
        spark, [0.0, 10.0, 49.99, 50.0, 79.99, 80.0], "double",
        numbers.coverage_band(F.col("x")), numbers.coverage_emoji(F.col("x")), numbers.treemap_colour(F.col("x")),
    )
    assert bands == [
        ("none", "🔴", "#991b1b"), ("fail", "🔴", "#991b1b"), ("fail", "🔴", "#f59e0b"),
        ("warn", "🟡", "#f59e0b"), ("warn", "🟡", "#84cc16"), ("pass", "🟢", "#22c55e"),
    ]
    assert apply(spark, [1.005, 33.335, 66.666666, -1.115], "double", numbers.round2(F.col("x"))) == [
        1.0, 33.34, 66.67, -1.12,
    ]


def test_paths(spark):
    paths = ["a/b/c.go", "c.go", "/c.go", "", "a//b/./c", "../x/y", "a/../../b/c", "/../a/b", "a/b/", "x/.."]
    got = apply(
        spark, paths, "string", text.clean_path(F.col("x")), text.dir_of(F.col("x")), text.base_name(F.col("x"))
    )
    assert got == [
        ("a/b/c.go", "a/b", "c.go"), ("c.go", "", "c.go"), ("/c.go", "/", "c.go"), (".", "", "."),
        ("a/b/c", "a/b", "c"), ("../x/y", "../x", "y"), ("../b/c", "../b", "c"), ("/a/b", "/a", "b"),
        ("a/b", "a/b", "b"), (".", "x", ".."),
    ]
    assert apply(spark, ["a.XML", "a.b/c", "x.tar.gz", ".info"], "string", text.file_extension(F.col("x"))) == [
        "xml", "", "gz", "info",
    ]


def test_texts(spark):
    assert apply(spark, ["a%b\r\nc:d,e", "]x;"], "string", text.esc_github(F.col("x")), text.esc_azure(F.col("x"))) == [
        ("a%25b%0D%0Ac%3Ad%2Ce", "a%b%0D%0Ac:d,e"), ("]x;", "%5Dx%3B"),
    ]
    assert apply(spark, [" one \r\ntwo", "\n", "x"], "string", text.first_line(F.col("x"))) == ["one", "", "x"]
    assert apply(spark, [" 　 a b  \t"], "string", text.trim_space(F.col("x"))) == ["a b"]
    assert apply(spark, ["<a>&"], "string", text.html_safe_json(F.col("x"))) == ["\\u003ca\\u003e\\u0026"]
    marks = ["[[ATTACHMENT| a ]]x[[ATTACHMENT|]][[ATTACHMENT|b]] [[ATTACHMENT|open", "none"]
    assert apply(spark, marks, "string", text.extract_attachments(F.col("x"))) == [["a", "b"], []]


def test_long_messages_are_cut_between_characters(spark):
    outputs = ["a" * 2048, "a" * 2049, "a" * 2047 + "é", "é" * 1024 + "x", "€" * 700, "a" * 2045 + "😀", "a" * 2044 + "😀"]

    def expected(s):
        raw = s.encode()
        return s if len(raw) <= 2048 else raw[:2048].decode("utf-8", "ignore") + "\n…"

    assert apply(spark, outputs, "string", text.go_fail_message(F.col("x"))) == [expected(s) for s in outputs]


def brute_match(glob: str, path: str) -> bool | None:
    """Independent matcher: backtracking over pattern tokens; None when malformed."""
    tokens, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "\\":
            if i + 1 == len(glob):
                return None
            tokens.append(("lit", glob[i + 1]))
            i += 2
        elif c == "[":
            i += 1
            negated = i < len(glob) and glob[i] == "^"
            i += negated
            ranges = []
            while True:
                if i >= len(glob):
                    return None
                if glob[i] == "]" and ranges:
                    break
                ends = []
                while True:
                    if i >= len(glob) or glob[i] in "]-":
                        return None
                    if glob[i] == "\\":
                        i += 1
                        if i >= len(glob):
                            return None
                    ends.append(glob[i])
                    i += 1
                    if len(ends) == 1 and i < len(glob) and glob[i] == "-":
                        i += 1
                        continue
                    break
                ranges.append((ends[0], ends[-1]))
            tokens.append(("set", negated, ranges))
            i += 1
        else:
            tokens.append((("star",) if c == "*" else ("any",) if c == "?" else ("lit", c)))
            i += 1

    def match(t: int, p: int) -> bool:
        if t == len(tokens):
            return p == len(path)
        kind = tokens[t]
        if kind[0] == "star":
            return match(t + 1, p) or (p < len(path) and path[p] != "/" and match(t, p + 1))
        if p == len(path):
            return False
        if kind[0] == "any":
            ok = path[p] != "/"
        elif kind[0] == "lit":
            ok = path[p] == kind[1]
        else:
            ok = any(low <= path[p] <= high for low, high in kind[2]) != kind[1]
        return ok and match(t + 1, p + 1)

    return match(0, 0)


def test_globs_against_brute_force(spark):
    rng = random.Random(11)
    patterns = [
        "*", "*.go", "a/*", "a?c", "[a-c]", "[^a]", "[a", "[]a]", "[-a]", "a\\", "\\*", "[z-a]", "[^z-a]", "a**c",
        "[a\\]]", "[&&b]", "a.c", "(a)", "a+", "*/b/*", "[^/]b", "[[]", "[a-]", "",
    ]
    patterns += ["".join(rng.choice("ab/*?[]^-\\.") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    paths = ["", "a", "b", "abc", "a/b", "a/b/c", "x.go", "a/x.go", "*", "]", "a-", "-", "[", "a.c", "axc", "(a)", "aa", "/b", "&", "a\nb"]
    df = spark.createDataFrame([(p,) for p in paths], "x string")
    out = df.select("x", *[globs.glob_match(F.col("x"), g).alias(f"g{i}") for i, g in enumerate(patterns)])
    for row in out.collect():
        for i, glob in enumerate(patterns):
            assert row[f"g{i}"] == bool(brute_match(glob, row["x"])), (glob, row["x"])


def test_exclude_patterns(spark):
    paths = ["vendor/a/b.go", "vendor", "vendored/x.go", "pkg/a_gen.go", "a/b/c_gen.go", "c_gen.go", "main.go"]
    excluded = apply(spark, paths, "string", globs.excluded(F.col("x"), ["vendor/**", "**/*_gen.go"]))
    assert excluded == [True, True, False, True, False, False, False]
    assert apply(spark, paths, "string", globs.excluded(F.col("x"), ["m*.go", "[bad"]))[-1] is True
