"""Formats by name, extension and content; plug-ins register DataFrame code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.text import trim_space
from buildlens.schemas import REJECTS, conform
from buildlens.sources.scan import Artifacts, scan_heads

TESTS = "tests"
COVERAGE = "coverage"


@dataclass(frozen=True)
class Format:
    """One input format: how to recognise it and how to read its files."""

    name: str
    extensions: tuple[str, ...]
    detect: Callable[[Column], Column]
    ingest: Callable[[SparkSession, Artifacts], Any] | None = None


_FORMATS: dict[str, list[Format]] = {TESTS: [], COVERAGE: []}

# Other names a format is known by.
ALIASES = {
    TESTS: {
        "gtest": "junit",
        "ctest": "junit",
        "maven": "junit",
        "xml": "junit",
        "go": "gotest",
        "json": "gotest",
        "xunit": "nunit",
        "nunit3": "nunit",
    },
    COVERAGE: {
        "go": "gocover",
        "go-cover": "gocover",
        "coverprofile": "gocover",
        "lcov": "lcov",
        "info": "lcov",
        "cobertura": "cobertura",
        "xml": "cobertura",
        "clover": "clover",
    },
}


def register_format(kind: str, fmt: Format) -> None:
    """Add a format, or replace the one of that name; earlier ones win detection."""
    known = _FORMATS[kind]
    for i, other in enumerate(known):
        if other.name == fmt.name:
            known[i] = fmt
            return
    known.append(fmt)


def unregister_format(kind: str, name: str) -> None:
    _FORMATS[kind] = [f for f in _FORMATS[kind] if f.name != name]


def formats(kind: str) -> list[Format]:
    return list(_FORMATS[kind])


def resolve_format(kind: str, name: str) -> Format:
    """The format of a forced name or alias."""
    wanted = name.strip().lower()
    wanted = ALIASES[kind].get(wanted, wanted)
    for fmt in _FORMATS[kind]:
        if fmt.name == wanted:
            return fmt
    raise ValueError(f"unknown format {name!r}; available: {', '.join(f.name for f in _FORMATS[kind])}")


def resolve_format_alias(name: Column, kind: str) -> Column:
    """Canonical format of a column of forced names; null when unknown."""
    wanted = F.lower(trim_space(name))
    table = {f.name: f.name for f in _FORMATS[kind]} | ALIASES[kind]
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*pairs)[wanted]


def detect_format(extension: Column, head: Column, kind: str) -> Column:
    """Format by extension, else by content in registration order; null when unknown."""
    by_extension = [F.when(extension.isin(*f.extensions), F.lit(f.name)) for f in _FORMATS[kind] if f.extensions]
    by_content = [F.when(f.detect(head), F.lit(f.name)) for f in _FORMATS[kind]]
    return F.coalesce(*by_extension, *by_content, F.lit(None).cast("string"))


def detect_by_content(extension: Column, head: Column, kind: str) -> Column:
    """Format by content first; the extension decides only where no sniffer fires."""
    by_content = [F.when(f.detect(head), F.lit(f.name)) for f in _FORMATS[kind]]
    return F.coalesce(*by_content, detect_format(extension, F.lit(""), kind))


def detect_artifacts(spark: SparkSession, inputs: Artifacts, kind: str, trust_extension: bool = True) -> DataFrame:
    """(run_id, source, source_ord, size, format) of every file; format is null for unknown files."""
    known = [e for f in _FORMATS[kind] for e in f.extensions if trust_extension]
    heads = scan_heads(spark, inputs, known)
    choose = detect_format if trust_extension else detect_by_content
    return heads.select(
        "run_id", "source", "source_ord", "size", choose(F.col("extension"), F.col("head"), kind).alias("format")
    )


def undetected(detected: DataFrame) -> DataFrame:
    """Reject rows of the files whose format is unknown."""
    return detected.where(F.col("format").isNull()).select(
        *conform(REJECTS, run_id=F.col("run_id"), source=F.col("source"), error=F.lit("cannot detect format"))
    )


def _contains_all(text: Column, *needles: str) -> Column:
    test = F.lit(True)
    for needle in needles:
        test = test & text.contains(needle)
    return test


def _contains_any(text: Column, *needles: str) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | text.contains(needle)
    return test


# Sniffers: what the first bytes of each format look like.


def looks_like_cucumber(head: Column) -> Column:
    return trim_space(head).startswith("[") & _contains_any(head, '"elements"', '"uri"')


def looks_like_gotest(head: Column) -> Column:
    return _contains_all(head, '"Action"', '"Package"')


def looks_like_junit(head: Column) -> Column:
    return F.lower(head).contains("<testsuite")


def looks_like_nunit(head: Column) -> Column:
    return _contains_any(head, "<test-run", "<test-results", "<assemblies")


def looks_like_tap(head: Column) -> Column:
    text = trim_space(head)
    return text.startswith("TAP version") | text.rlike(r"^\d+\.\.\d+")


def looks_like_clover(head: Column) -> Column:
    return _contains_all(F.lower(head), "<coverage", "clover=")


def looks_like_cobertura(head: Column) -> Column:
    return _contains_all(F.lower(head), "<coverage", "line-rate")


def looks_like_gocover(head: Column) -> Column:
    return trim_space(head).rlike(r"^mode: (set|count|atomic)")


def looks_like_jacoco(head: Column) -> Column:
    return _contains_all(F.lower(head), "<report", "jacoco")


def looks_like_lcov(head: Column) -> Column:
    return head.contains("SF:") | trim_space(head).startswith("TN:")


for _fmt in (
    Format("cucumber", (), looks_like_cucumber),
    Format("gotest", (), looks_like_gotest),
    Format("junit", ("xml",), looks_like_junit),
    Format("nunit", (), looks_like_nunit),
    Format("tap", ("tap",), looks_like_tap),
):
    register_format(TESTS, _fmt)

for _fmt in (
    Format("clover", (), looks_like_clover),
    Format("cobertura", ("xml",), looks_like_cobertura),
    Format("gocover", ("out",), looks_like_gocover),
    Format("jacoco", ("xml",), looks_like_jacoco),
    Format("lcov", ("info",), looks_like_lcov),
):
    register_format(COVERAGE, _fmt)
