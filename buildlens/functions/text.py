"""String expressions: trimming, paths, escapes, message clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters.
SPACE_CHARS = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def trim_space(c: Column) -> Column:
    """Trim all Unicode white space, not only the space character."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def split_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def drop_first(items: Column) -> Column:
    """Array without its first element."""
    return F.slice(items, F.lit(2), F.size(items))


def first_line(c: Column) -> Column:
    """Text before the first CR or LF, trimmed."""
    return trim_space(F.regexp_extract(c, r"^([^\r\n]*)", 1))


def clean_path(p: Column) -> Column:
    """Resolve `.`, `..` and repeated slashes; the empty path is `.`."""
    rooted = p.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(part != "..", F.array_append(acc, part))
            .when((F.size(acc) > 0) & can_pop, popped)
            .when(rooted, acc)
            .otherwise(F.array_append(acc, part))
        )

    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    full = F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
    # Nearly every path is already clean, so the array work is rarely reached.
    is_clean = (p == "/") | ((p != "") & ~p.rlike(r"(^|/)\.{1,2}(/|$)|//|/$"))
    return F.when(is_clean, p).otherwise(full)


def dir_of(p: Column) -> Column:
    """Cleaned parent directory; empty for a bare file name."""
    parent = clean_path(F.regexp_extract(p, r"^(?s)(.*/)?[^/]*$", 1))
    return F.when(parent == ".", F.lit("")).otherwise(parent)


def base_name(p: Column) -> Column:
    """Last path segment, ignoring trailing slashes."""
    tail = F.substring_index(F.regexp_replace(p, r"/+$", ""), "/", -1)
    return F.when(p == "", F.lit(".")).when(tail == "", F.lit("/")).otherwise(tail)


def file_extension(p: Column) -> Column:
    """Lower-case extension of the last segment without the dot, or empty."""
    return F.lower(F.regexp_extract(p, r"\.([^./]*)$", 1))


def slash_join(left: Column, right: Column) -> Column:
    """Clean join of two path parts; an empty part is ignored."""
    joined = F.concat_ws("/", blank_to_null(left), blank_to_null(right))
    return F.when(joined == "", F.lit("")).otherwise(clean_path(joined))


def strip_prefix(p: Column, prefix: str) -> Column:
    """Drop a directory prefix where the path starts with it."""
    if not prefix:
        return p
    full = prefix if prefix.endswith("/") else prefix + "/"
    return F.when(p.startswith(full), F.substr(p, F.lit(len(full) + 1))).otherwise(p)


def _replace_in_order(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def esc_github(c: Column) -> Column:
    """Escapes of GitHub workflow commands (the percent sign goes first)."""
    return _replace_in_order(c, [("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")])


def esc_azure(c: Column) -> Column:
    """Escapes of Azure logging commands; the percent sign stays."""
    return _replace_in_order(c, [("\r", "%0D"), ("\n", "%0A"), ("]", "%5D"), (";", "%3B")])


def html_safe_json(c: Column) -> Column:
    """JSON text that is safe inside a script element."""
    return _replace_in_order(c, [("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")])


def extract_attachments(c: Column) -> Column:
    """Every non-empty span between an attachment marker and the next `]]`."""
    pieces = drop_first(F.split(c, r"\[\[ATTACHMENT\|", -1))
    marked = F.filter(pieces, lambda x: F.instr(x, "]]") > 1)
    return F.transform(marked, lambda x: trim_space(F.substring_index(x, "]]", 1)))


def ctest_skip_reason(message: Column, stdout: Column) -> Column:
    """Replace a synthetic skip message by the reason printed in the output."""
    hits = F.filter(
        F.transform(split_lines(stdout), trim_space),
        lambda x: x.contains("Skipped") & x.contains(": "),
    )
    found = F.get(hits, F.lit(0))
    reason = F.when(found.isNotNull(), F.substr(found, F.instr(found, ": ") + F.lit(2)))
    synthetic = message.isin("SKIP_REGULAR_EXPRESSION_MATCHED", "")
    return F.when(synthetic & reason.isNotNull(), reason).otherwise(message)


def _starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    test = c == ""
    for prefix in prefixes:
        test = test | c.startswith(prefix)
    return test


def go_skip_reason(out: Column) -> Column:
    """First output line that is not go test boilerplate, or empty."""
    lines = F.filter(
        F.transform(split_lines(out), trim_space),
        lambda x: ~_starts_with_any(x, ("--- SKIP:", "=== RUN")),
    )
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


# Fixed value: the longest failure message kept, in bytes.
FAIL_MESSAGE_BYTES = 2048


def go_fail_message(out: Column) -> Column:
    """Failure text without go test boilerplate, cut to the byte limit."""
    lines = F.filter(
        F.transform(split_lines(out), trim_space),
        lambda x: ~_starts_with_any(x, ("--- ", "=== RUN")),
    )
    text = F.array_join(lines, "\n")
    # A cut lands on a UTF-8 continuation byte only in multi-byte text, where
    # the cut moves back to the last whole character.
    encoded = F.encode(text, "UTF-8")
    next_byte = F.hex(F.substring(encoded, FAIL_MESSAGE_BYTES + 1, 1))
    back = F.lit(0)
    for width in (1, 2, 3):
        byte = F.hex(F.substring(encoded, FAIL_MESSAGE_BYTES + 1 - width, 1))
        back = F.when((back == width - 1) & next_byte.rlike("^[89AB]"), F.lit(width)).otherwise(back)
        next_byte = byte
    cut = F.decode(F.substr(encoded, F.lit(1), F.lit(FAIL_MESSAGE_BYTES) - back), "UTF-8")
    return F.when(
        F.octet_length(text) > FAIL_MESSAGE_BYTES, F.concat(cut, F.lit("\n…"))
    ).otherwise(text)
