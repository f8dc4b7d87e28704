"""Reading artifacts of any known format, forced or detected."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.session import materialize
from buildlens.sources import registry
from buildlens.sources.clover import ingest_clover
from buildlens.sources.cobertura import ingest_cobertura
from buildlens.sources.cucumber import ingest_cucumber
from buildlens.sources.facts import CoverageFacts, TestFacts
from buildlens.sources.gocover import ingest_gocover
from buildlens.sources.gotest import ingest_gotest
from buildlens.sources.jacoco import ingest_jacoco
from buildlens.sources.junit import ingest_junit
from buildlens.sources.lcov import ingest_lcov
from buildlens.sources.nunit import ingest_nunit
from buildlens.sources.scan import Artifacts
from buildlens.sources.tap import ingest_tap

# A reader is told the names of up to so many files.
NAMED_FILES = 5000

_READERS = {
    registry.TESTS: {
        "cucumber": ingest_cucumber, "gotest": ingest_gotest, "junit": ingest_junit, "nunit": ingest_nunit,
        "tap": ingest_tap,
    },
    registry.COVERAGE: {
        "clover": ingest_clover, "cobertura": ingest_cobertura, "gocover": ingest_gocover, "jacoco": ingest_jacoco,
        "lcov": ingest_lcov,
    },
}
for _kind, _readers in _READERS.items():
    for _name, _reader in _readers.items():
        registry.register_format(_kind, replace(registry.resolve_format(_kind, _name), ingest=_reader))


def _literal_path(path: str) -> str:
    """A file name as a path pattern that matches only itself."""
    return "".join("\\" + c if c in "\\{}[]*?" else c for c in path)


def _detected_facts(spark: SparkSession, inputs: Artifacts, kind: str, trust_extension: bool):
    """Each format's reader gets the files of its format.

    While they are few, it is told their names. Beyond that no name passes through the driver:
    it is given the table of its files, which are picked out where the folders are read.
    """
    found = materialize(registry.detect_artifacts(spark, inputs, kind, trust_extension), "formats")
    numbers = {r["format"]: r["count"] for r in found.groupBy("format").count().collect()}
    parts = []
    for fmt in registry.formats(kind):
        files = found.where(F.col("format") == fmt.name).select("source", "size")
        if 0 < numbers.get(fmt.name, 0) <= NAMED_FILES:
            paths = tuple(_literal_path(r["source"]) for r in files.collect())
            parts.append(fmt.ingest(spark, replace(inputs, paths=paths)))
        elif fmt.name in numbers:
            parts.append(fmt.ingest(spark, replace(inputs, only=files)))
    return found, parts


def ingest_tests(
    spark: SparkSession, inputs: Artifacts, fmt: str = "auto", trust_extension: bool = True
) -> TestFacts:
    """Test results of one format, or of the formats the files turn out to have.

    Files of no known format become rejects.
    """
    if fmt != "auto":
        return registry.resolve_format(registry.TESTS, fmt).ingest(spark, inputs)
    found, parts = _detected_facts(spark, inputs, registry.TESTS, trust_extension)
    return _merged(found, parts)


def ingest_coverage(
    spark: SparkSession, inputs: Artifacts, fmt: str = "auto", prefix: str = "", trust_extension: bool = True
) -> CoverageFacts:
    """Coverage of one format or of detected formats, with a path prefix dropped."""
    if fmt != "auto":
        facts = registry.resolve_format(registry.COVERAGE, fmt).ingest(spark, inputs)
    else:
        found, parts = _detected_facts(spark, inputs, registry.COVERAGE, trust_extension)
        facts = _merged(found, parts)
    return facts.with_prefix_stripped(prefix)


def _merged(found: DataFrame, parts: list):
    if not parts:
        raise ValueError("no input has a known format; name one")
    facts = reduce(lambda a, b: a.union(b), parts)
    return replace(facts, rejects=facts.rejects.unionByName(registry.undetected(found)))
