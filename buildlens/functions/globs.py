"""Shell globs as anchored Java regular expressions.

`*` and `?` stay inside one path segment; classes are `[abc]`, `[a-z]`, `[^…]`;
a backslash takes the next character literally. Patterns that the caller lists are
translated once while the query is built, those of a table by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens.functions.text import base_name
from buildlens.plans.inrow import let

_META = set(r"\.[]{}()<>*+-=!?^$|&~#/")
_NOTHING = r"[^\x{0}-\x{10FFFF}]"
_ANYTHING = r"[\x{0}-\x{10FFFF}]"


def _quote(ch: str) -> str:
    return "\\" + ch if ch in _META else ch


def _read_class_char(glob: str, i: int) -> tuple[str, int] | None:
    """One literal inside a class, with its end; None when it is malformed."""
    if i >= len(glob) or glob[i] in "-]":
        return None
    if glob[i] == "\\":
        i += 1
        if i >= len(glob):
            return None
    return glob[i], i + 1


def _translate_class(glob: str, i: int) -> tuple[str, int] | None:
    """Class whose text starts at `i`, after the opening bracket."""
    negated = glob[i : i + 1] == "^"
    i += negated
    ranges: list[str] = []
    count = 0
    while not (count and glob[i : i + 1] == "]"):
        low = _read_class_char(glob, i)
        if low is None:
            return None
        first, i = low
        last = first
        if glob[i : i + 1] == "-":
            high = _read_class_char(glob, i + 1)
            if high is None:
                return None
            last, i = high
        count += 1
        if first <= last:
            ranges.append(f"{_quote(first)}-{_quote(last)}")
    if not ranges:
        return (_ANYTHING if negated else _NOTHING), i + 1
    return f"[{'^' if negated else ''}{''.join(ranges)}]", i + 1


def glob_to_regex(glob: str) -> str | None:
    """Regex of the whole-string match, or None for a malformed pattern."""
    out: list[str] = []
    i = 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            found = _translate_class(glob, i)
            if found is None:
                return None
            out.append(found[0])
            i = found[1]
        elif ch == "\\":
            if i >= len(glob):
                return None
            out.append(_quote(glob[i]))
            i += 1
        else:
            out.append(_quote(ch))
    return "(?s)^" + "".join(out) + "\\z"


# The same grammar for patterns of a table: what a class holds, and the tokens of a pattern.
_CLASS_CHAR = r"(?:\\.|[^\\\]-])"
_CLASS_ITEM = rf"{_CLASS_CHAR}(?:-{_CLASS_CHAR})?+"
_TOKENS = rf"(?s)\\.|\[\^?+(?:{_CLASS_ITEM})++\]|[^\\\[]"
_META_CLASS = "[" + "".join("\\" + c for c in sorted(_META)) + "]"


def glob_tokens(glob: Column) -> Column:
    """Wildcards, classes and characters of each row's pattern; null where it is malformed."""
    return let(
        F.regexp_extract_all(glob, F.lit(_TOKENS), F.lit(0)),
        lambda tokens: F.when(F.array_join(tokens, "") == glob, tokens),
    )


def token_text(token: Column) -> Column:
    """The one character that a token stands for, or null for a wildcard."""
    single = token.startswith("[") & ~token.startswith("[^")
    return (
        F.when(token.isin("*", "?"), F.lit(None).cast("string"))
        .when(token.startswith("\\"), F.substring(token, 2, 1))
        .when(single & ~token.startswith("[\\") & (F.length(token) == 3), F.substring(token, 2, 1))
        .when(token.startswith("[\\") & (F.length(token) == 4), F.substring(token, 3, 1))
        .when(token.startswith("["), F.lit(None).cast("string"))
        .otherwise(token)
    )


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, _META_CLASS, r"\\$0")


def _class_regex(token: Column) -> Column:
    """Regex of a token that is a class; ranges whose ends are the wrong way round hold nothing."""

    def range_of(item: Column) -> Column:
        first, last = (F.substring(F.regexp_extract(item, r"(?s)^(\\?.)(?:-(\\?.))?$", i), -1, 1) for i in (1, 2))
        return F.struct(first.alias("first"), F.when(last == "", first).otherwise(last).alias("last"))

    negated = token.startswith("[^")
    body = F.regexp_extract(token, r"(?s)^\[\^?(.*)\]$", 1)
    items = F.transform(F.regexp_extract_all(body, F.lit("(?s)" + _CLASS_ITEM), F.lit(0)), range_of)
    ranges = F.transform(
        F.filter(items, lambda x: x["first"] <= x["last"]), lambda x: F.concat(_quoted(x["first"]), F.lit("-"), _quoted(x["last"]))
    )
    mark = F.when(negated, F.lit("^")).otherwise(F.lit(""))
    nothing = F.when(negated, F.lit(_ANYTHING)).otherwise(F.lit(_NOTHING))
    return let(ranges, lambda r: F.when(F.size(r) > 0, F.concat(F.lit("["), mark, F.array_join(r, ""), F.lit("]"))).otherwise(nothing))


def tokens_regex(tokens: Column) -> Column:
    """`glob_to_regex` of each row's tokens, without its anchors."""
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t == "*", F.lit("[^/]*"))
            .when(t == "?", F.lit("[^/]"))
            .when(t.startswith("["), _class_regex(t))
            .otherwise(_quoted(token_text(t))),
        ),
        "",
    )


def glob_match(c: Column, glob: str) -> Column:
    """Whole-string glob test; a malformed pattern matches nothing."""
    regex = glob_to_regex(glob)
    return F.lit(False) if regex is None else F.coalesce(c.rlike(regex), F.lit(False))


def excluded(path: Column, globs: list[str]) -> Column:
    """True where any exclude pattern covers the path.

    `dir/**` covers a whole tree; any other pattern is tried on the full path
    and then on the base name.
    """
    test = F.lit(False)
    for glob in globs:
        if glob.endswith("/**"):
            tree = glob[: -len("/**")]
            test = test | path.startswith(tree + "/") | (path == tree)
        else:
            test = test | glob_match(path, glob) | glob_match(base_name(path), glob)
    return test
