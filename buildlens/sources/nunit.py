"""NUnit 3, NUnit 2 and xUnit .NET documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.functions.numbers import parse_float, seconds_to_nanos
from buildlens.functions.text import blank_to_null, trim_space
from buildlens.plans.skew import attach, parts_for
from buildlens.schemas import record_seq
from buildlens.session import materialize
from buildlens.sources import facts
from buildlens.sources.scan import Artifacts, scan_documents
from buildlens.sources.xmltext import XML_OPTIONS, array_or_empty, parsed_documents, root_element, text_or_empty

_FAILURE = "STRUCT<message: STRING, `stack-trace`: STRING>"
_NUNIT_CASE = f"_name STRING, _result STRING, _duration STRING, failure {_FAILURE}, reason STRUCT<message: STRING>"
_XUNIT_TEST = f"STRUCT<_name: STRING, _result: STRING, _time: STRING, failure: {_FAILURE}>"
_XUNIT = (
    "assembly ARRAY<STRUCT<_name: STRING, collection: ARRAY<STRUCT<_name: STRING, "
    f"test: ARRAY<{_XUNIT_TEST}>>>>>"
)
_FLAT = "struct<suite: string, name: string, status: string, seconds: string, message: string>"


def map_status(result: Column, dialect: str) -> Column:
    """Status of an NUnit or xUnit result word; unknown words are skips."""
    # The result words of each dialect.
    words = {"nunit": (("passed", "success"), ("failed", "error")), "xunit": (("pass",), ("fail",))}
    good, bad = words[dialect]
    word = F.lower(result)
    return F.when(word.isin(*good), "pass").when(word.isin(*bad), "fail").otherwise("skip")


def _failure_text(failure: Column) -> Column:
    return trim_space(
        F.concat(text_or_empty(failure["message"]), F.lit("\n"), text_or_empty(failure["stack-trace"]))
    )


def _flat_case(suite: Column, case: Column, dialect: str, seconds: str, message: Column) -> Column:
    return F.struct(
        suite.alias("suite"),
        text_or_empty(case["_name"]).alias("name"),
        map_status(text_or_empty(case["_result"]), dialect).alias("status"),
        trim_space(text_or_empty(case[seconds])).alias("seconds"),
        message.alias("message"),
    ).cast(_FLAT)


def _nested(items: Column, cases_of) -> Column:
    return array_or_empty(F.flatten(F.transform(items, cases_of)), _FLAT)


def _xunit_cases(assemblies: Column) -> Column:
    def of_collection(assembly: Column, collection: Column) -> Column:
        suite = F.coalesce(blank_to_null(collection["_name"]), text_or_empty(assembly["_name"]))

        def one(test: Column) -> Column:
            message = F.when(test["failure"].isNotNull(), _failure_text(test["failure"]))
            return _flat_case(suite, test, "xunit", "_time", message)

        return array_or_empty(F.transform(collection["test"], one), _FLAT)

    return _nested(
        assemblies, lambda a: _nested(a["collection"], lambda c: of_collection(a, c))
    )


def _test_cases(rows: DataFrame, case: Column, seq: Column) -> DataFrame:
    return facts.test_cases(
        rows,
        suite=case["suite"],
        seq=seq,
        name=case["name"],
        status=case["status"],
        duration_ns=seconds_to_nanos(parse_float(case["seconds"])),
        message=blank_to_null(case["message"]),
    )


def _facts(docs: DataFrame, cases: Column, broken: Column, dialect: str) -> facts.TestFacts:
    """Explode the flat cases of sound documents; the parse is done once."""
    parsed = materialize(
        docs.select(
            "run_id", "source", "source_ord",
            broken.alias("broken"),
            F.when(~broken, cases).alias("cases"),
        ),
        dialect,
    )
    # A time that is not a number makes the whole document invalid.
    bad_time = F.exists("cases", lambda c: (c["seconds"] != "") & parse_float(c["seconds"]).isNull())
    parsed = parsed.withColumn("broken", F.col("broken") | F.coalesce(bad_time, F.lit(False)))
    sound = parsed.where(~F.col("broken"))
    rows = sound.select("run_id", "source", "source_ord", F.posexplode("cases").alias("pos", "case"))
    start = F.struct(F.lit(0).alias("block_start"), F.lit(0).alias("row_id"))
    return facts.TestFacts(
        _test_cases(rows, F.col("case"), record_seq(start, F.col("pos"))),
        facts.test_runs(sound, duration_ns=F.lit(0)),
        facts.rejects(parsed.where("broken"), dialect, "malformed or unexpected XML"),
    )


# A document is cut in front of the tags of suites and cases. Cases stay in one piece, so each can
# be parsed by itself; suites are intervals of pieces, however deep they nest.
_NAMED = r"</?(?:[\w.-]+:)?test-(suite|case)(?=[\s/>])"
_ATTRIBUTES = r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+"
_TAG = rf"^<{_ATTRIBUTES}>"


def plain_markup(text: Column) -> Column:
    """A document without comments, and with CDATA sections as escaped text."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|[^<]+|<"), F.lit(0))

    def plain(token: Column) -> Column:
        content = F.substr(token, F.lit(10), F.length(token) - 12)
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            content = F.replace(content, F.lit(old), F.lit(new))
        return F.when(token.startswith("<!--"), "").when(token.startswith("<![CDATA["), content).otherwise(token)

    return F.when(text.contains("<!--") | text.contains("<![CDATA["), F.array_join(F.transform(tokens, plain), "")).otherwise(text)


def nested_cases(pieces: DataFrame, parts: int | None = None) -> DataFrame:
    """Cases that are direct children of a suite, with the suite's name and place.

    `pieces` are a document's parts in order (pos, text). A running sum over them counts the open
    suites, another one the other open elements; a case lies directly in a suite when the root is
    the only other one. Its suite is the one that was opened last at that level. With `parts` the
    documents are spread over so many tasks.
    """
    if parts:
        pieces = pieces.repartition(parts, "run_id", "source")
    text = F.col("text")
    kind = F.regexp_extract("text", "^" + _NAMED, 1)
    tag = F.regexp_extract("text", _TAG, 0)
    marked = pieces.withColumns({"kind": kind, "tag": tag, "closes": text.startswith("</"), "alone": tag.endswith("/>")})
    starts, ends = F.regexp_count("text", F.lit("<[^/!?]")), F.regexp_count("text", F.lit("</"))
    alone = F.regexp_count("text", F.lit(rf"<[^/!?]{_ATTRIBUTES}(?<=/)>"))
    suite = F.when((F.col("kind") != "suite") | (~F.col("closes") & F.col("alone")), 0).when(F.col("closes"), -1).otherwise(1)
    counted = marked.withColumns({"all": starts - ends - alone, "suites": suite})
    document = Window.partitionBy("run_id", "source").orderBy("pos")
    level = F.sum("suites").over(document)
    # The piece that opens an element is its first, so what it opens itself is taken off again.
    other = F.sum(F.col("all") - F.col("suites")).over(document) - (F.col("all") - F.col("suites"))
    placed = counted.withColumns({"level": level, "other": other}).where("NOT closes AND kind <> ''")
    opened = F.struct("pos", "tag")
    same_level = Window.partitionBy("run_id", "source", "level").orderBy("pos")
    last = F.last(F.when((F.col("kind") == "suite") & ~F.col("alone"), opened), ignorenulls=True).over(same_level)
    found = placed.withColumn("suite", last).where("kind = 'case' AND level > 0 AND other = 1")
    own = F.when(F.col("all") == F.when(F.col("alone"), 0).otherwise(1), text)  # a case with suites in it keeps its tag
    body = F.when(F.col("alone") | own.isNull(), _alone(F.col("tag"), F.col("alone"))).otherwise(
        F.concat(text, F.lit("</"), F.regexp_extract("tag", r"^<([^\s/>]+)", 1), F.lit(">"))
    )
    case = F.from_xml(body, _NUNIT_CASE, XML_OPTIONS)
    name = F.from_xml(_alone(F.col("suite.tag"), F.lit(False)), "_name STRING", XML_OPTIONS)
    return found.select("run_id", "source", "source_ord", F.col("suite.pos").alias("suite_pos"), "pos", name.alias("suite"), case.alias("case"))


def _alone(tag: Column, alone: Column) -> Column:
    """A start tag as an element of its own."""
    return F.when(alone, tag).otherwise(F.concat(F.substr(tag, F.lit(1), F.length(tag) - 1), F.lit("/>")))


def _ingest_nunit(docs: DataFrame, root: str, dialect: str) -> facts.TestFacts:
    """Cases of nested suites; the plan is the same however deep any document nests them."""
    parsed = parsed_documents(docs, "_name STRING")
    broken = F.col("broken") | (root_element(F.col("value")) != root)
    pieces = F.when(~broken, F.split(plain_markup(F.col("value")), f"(?={_NAMED})", -1))
    stored = materialize(parsed.select("run_id", "source", "source_ord", broken.alias("broken"), pieces.alias("pieces")), dialect)
    cut = stored.where("NOT broken").select("run_id", "source", "source_ord", F.posexplode("pieces").alias("pos", "text"))
    pieces_in_all = stored.agg(F.sum(F.size("pieces"))).first()[0] or 0
    case = F.col("case")
    reason = F.when(case["reason"].isNotNull(), text_or_empty(case["reason"]["message"]))
    message = F.when(case["failure"].isNotNull(), _failure_text(case["failure"])).otherwise(reason)
    flat = _flat_case(text_or_empty(F.col("suite._name")), case, "nunit", "_duration", message)
    found = materialize(
        nested_cases(cut, parts_for(pieces_in_all, stored)).select("run_id", "source", "source_ord", "suite_pos", "pos", flat.alias("case")), f"{dialect}-cases"
    )
    # A time that is not a number makes the whole document invalid.
    bad = found.where((case["seconds"] != "") & parse_float(case["seconds"]).isNull()).select("source").distinct()
    marked = attach(stored.drop("pieces"), bad.withColumn("bad", F.lit(True)), ["source"])
    marked = materialize(marked.withColumn("broken", F.col("broken") | F.coalesce("bad", F.lit(False))), f"{dialect}-documents")
    rejected = marked.where("broken")
    start = F.struct(F.lit(0).alias("block_start"), F.lit(0).alias("row_id"))
    seq = record_seq(start, F.col("suite_pos"), F.col("pos"))
    return facts.TestFacts(
        _test_cases(facts.without_rejected(found, rejected), case, seq),
        facts.test_runs(marked.where("NOT broken"), duration_ns=F.lit(0)),
        facts.rejects(rejected, dialect, "malformed or unexpected XML"),
    )


def dialect_of(text: Column) -> Column:
    """The dialect that a document's text names."""
    return (
        F.when(text.contains("<assemblies"), "xunit").when(text.contains("<test-results"), "nunit2").otherwise("nunit3")
    )


def _documents(spark: SparkSession, inputs: Artifacts) -> DataFrame:
    return scan_documents(spark, inputs).withColumn("dialect", dialect_of(F.col("value")))


def _of_dialect(docs: DataFrame, dialect: str) -> facts.TestFacts:
    own = docs.where(F.col("dialect") == dialect)
    if dialect == "xunit":
        parsed = parsed_documents(own, _XUNIT)
        broken = F.col("broken") | (root_element(F.col("value")) != "assemblies")
        return _facts(parsed, _xunit_cases(F.col("doc.assembly")), broken, "xunit")
    return _ingest_nunit(own, {"nunit3": "test-run", "nunit2": "test-results"}[dialect], dialect)


def ingest_nunit3(spark: SparkSession, inputs: Artifacts) -> facts.TestFacts:
    """Documents with a <test-run> root; every suite with direct cases is a suite."""
    return _of_dialect(_documents(spark, inputs), "nunit3")


def ingest_nunit2(spark: SparkSession, inputs: Artifacts) -> facts.TestFacts:
    """Documents with a <test-results> root."""
    return _of_dialect(_documents(spark, inputs), "nunit2")


def ingest_xunit(spark: SparkSession, inputs: Artifacts) -> facts.TestFacts:
    """Documents with an <assemblies> root; a collection is a suite."""
    return _of_dialect(_documents(spark, inputs), "xunit")


def ingest_nunit(spark: SparkSession, inputs: Artifacts) -> facts.TestFacts:
    """All three dialects; a document is read once and goes to the one its text names."""
    docs = materialize(_documents(spark, inputs), "nunit-documents")
    nunit3, nunit2, xunit = (_of_dialect(docs, d) for d in ("nunit3", "nunit2", "xunit"))
    return nunit3.union(nunit2).union(xunit)
