"""Shared pieces of the XML readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Surrounding spaces are part of a value; the readers trim where they must.
XML_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}
CORRUPT = "_corrupt_record"


def parsed_documents(docs: DataFrame, schema: str) -> DataFrame:
    """Parse whole documents into `doc`; `broken` marks those that are not well formed."""
    doc = F.from_xml("value", f"{schema}, {CORRUPT} STRING", XML_OPTIONS)
    return docs.withColumn("doc", doc).withColumn(
        "broken", F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull()
    )


def start_tags(text: Column, names: str) -> Column:
    """Start tags of the named elements in document order, outside comments and CDATA."""
    markup = F.regexp_replace(text, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    attributes = r"(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*"
    return F.regexp_extract_all(markup, F.lit(rf"<(?:[\w.-]+:)?(?:{names}){attributes}\s*/?>"), F.lit(0))


def tag_attribute(tag: Column, name: str) -> Column:
    """Attribute value inside a start tag, or empty."""
    quoted = F.regexp_extract(tag, rf"\s(?:[\w.-]+:)?{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def root_element(text: Column) -> Column:
    """Local name of the root element."""
    markup = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.regexp_extract(markup, r"<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)", 1)


def array_or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))
