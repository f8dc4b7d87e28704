"""Cucumber JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.text import blank_to_null, trim_space
from buildlens.schemas import record_seq
from buildlens.session import materialize
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, scan_documents
from buildlens.sources.xmltext import array_or_empty, text_or_empty

_STEPS = "array<struct<result: struct<status: string, duration: bigint, error_message: string>>>"
# A duration is kept as it is written, since it must be a whole number.
_FEATURES = (
    "array<struct<name: string, uri: string, elements: array<struct<name: string, type: string, "
    f"steps: {_STEPS.replace('duration: bigint', 'duration: variant')}>>>>"
)
_FLAT = "struct<suite: string, name: string, status: string, duration_ns: bigint, message: string>"


def scenario_rollup(steps: Column) -> dict[str, Column]:
    """Status, total time and failure text of a scenario from its steps."""

    def has(*words: str) -> Column:
        return F.exists(steps, lambda s: F.coalesce(F.lower(s["result"]["status"]).isin(*words), F.lit(False)))

    failed = F.filter(
        steps,
        lambda s: (F.lower(s["result"]["status"]) == "failed") & (s["result"]["error_message"] != ""),
    )
    return {
        "status": F.when(has("failed"), "fail").when(has("skipped", "pending", "undefined"), "skip").otherwise("pass"),
        "duration_ns": F.aggregate(
            steps,
            F.lit(0).cast("bigint"),
            lambda acc, s: acc + F.coalesce(s["result"]["duration"], F.lit(0).cast("bigint")),
        ),
        "message": F.array_join(F.transform(failed, lambda s: s["result"]["error_message"]), "\n"),
    }


def _scenarios(features: Column) -> Column:
    def of_feature(feature: Column) -> Column:
        suite = F.coalesce(blank_to_null(feature["name"]), text_or_empty(feature["uri"]))

        def one(element: Column) -> Column:
            rolled = scenario_rollup(array_or_empty(F.transform(element["steps"], _timed), _STEPS[len("array<") : -1]))
            return F.struct(
                suite.alias("suite"),
                text_or_empty(element["name"]).alias("name"),
                *[value.alias(key) for key, value in rolled.items()],
            ).cast(_FLAT)

        kept = F.filter(feature["elements"], lambda e: F.coalesce(e["type"] != "background", F.lit(True)))
        return array_or_empty(F.transform(kept, one), _FLAT)

    return array_or_empty(F.flatten(F.transform(features, of_feature)), _FLAT)


def _timed(step: Column) -> Column:
    result = step["result"]
    duration = F.try_variant_get(result["duration"], "$", "bigint")
    timed = F.struct(result["status"].alias("status"), duration.alias("duration"), result["error_message"].alias("error_message"))
    return F.struct(F.when(result.isNotNull(), timed).alias("result"))


def has_bad_duration(features: Column) -> Column:
    """Whether any step's duration is something else than a whole number of 64 bits, or null."""

    def bad(step: Column) -> Column:
        kind = F.schema_of_variant(step["result"]["duration"])
        return F.coalesce(~kind.isin("BIGINT", "VOID"), F.lit(False))

    def any_step(items: Column, test) -> Column:
        return F.coalesce(F.exists(items, test), F.lit(False))

    return any_step(features, lambda f: any_step(f["elements"], lambda e: any_step(e["steps"], bad)))


def ingest_cucumber(spark: SparkSession, inputs: Artifacts) -> facts.TestFacts:
    """One case per scenario; background elements are left out."""
    docs = scan_documents(spark, inputs)
    features = F.from_json("value", _FEATURES)
    parsed = materialize(
        docs.select(
            "run_id", "source", "source_ord",
            F.when(trim_space(F.col("value")).startswith("["), _scenarios(features)).alias("cases"),
            (~trim_space(F.col("value")).startswith("[") | features.isNull()).alias("broken"),
            has_bad_duration(features).alias("bad_duration"),
        ),
        "cucumber",
    )
    sound = parsed.where(~F.col("broken") & ~F.col("bad_duration"))
    rows = sound.select("run_id", "source", "source_ord", F.posexplode("cases").alias("pos", "case"))
    case = F.col("case")
    start = F.struct(F.lit(0).alias("block_start"), F.lit(0).alias("row_id"))
    cases = facts.test_cases(
        rows,
        suite=case["suite"],
        seq=record_seq(start, F.col("pos")),
        name=case["name"],
        status=case["status"],
        duration_ns=case["duration_ns"],
        message=blank_to_null(case["message"]),
    )
    return facts.TestFacts(
        cases,
        facts.test_runs(sound, duration_ns=F.lit(0)),
        facts.rejects(parsed.where("broken"), "cucumber", "malformed JSON").unionByName(
            facts.rejects(parsed.where("NOT broken AND bad_duration"), "cucumber", "duration is no whole number")
        ),
    )
