"""Kept columns with the names of added ones, of scratch ones, with dots, and the text itself."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from buildlens.llm import (
    alignment, decontamination, importance, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, queries, secrets,
    simhash, substring_dedup, toxicity,
)

# Names that operators add or use on the way.
NAMES = [
    "piece", "length", "ids", "_salt", "sequence_id", "fp", "root", "component_id", "first", "score", "held_out", "predicted", "n_words",
    "covered", "kept", "names", "_ord", "_t1", "x", "label", "secret", "start", "features", "row", "base", "spans", "n_lines", "removed",
    "doc", "t1", "n_hit", "item_ids", "size", "target", "taken", "s", "pairs", "n_a", "bucket", "rank", "weight", "a.b", "k0", "K1", "path",
]
OPERATORS = {
    "op1": (lambda d, c, more: packing.pack(d, c, queries.tokenizer_path()), {"piece", "start", "length", "ids", "sequence_id", "offset"}),
    "op2": (lambda d, c, more: simhash.near_duplicates(d, c), {"fp", "root", "component_id"}),
    "op3": (lambda d, c, more: toxicity.toxicity(d, more[0], c), {"held_out", "score", "predicted"}),
    "op4": (lambda d, c, more: line_dedup.deduplicate(d, c), {"n_lines", "removed"}),
    "op5": (lambda d, c, more: quality_rules.apply_rules(d, c), {"base_failed", "kept", *[x.split()[0] for x in quality_rules.STATS.split(", ")]}),
    "op6": (lambda d, c, more: substring_dedup.remove_repeats(d, c), {"n_words", "n_removed", "spans", "kept_sha256"}),
    "op7": (lambda d, c, more: quality_classifier.quality(d, more[0], c), {"held_out", "score", "predicted"}),
    "op8": (
        lambda d, c, more: secrets.scan(d, c, "a.b"),
        {"number", "start", "end", "secret", "before", "after", "path", *secrets.FEATURES, "score", "is_secret"},
    ),
    "op9": (lambda d, c, more: pii.find(d, c), {"base", "spans"}),
    "op10": (lambda d, c, more: decontamination.decontaminate(d, more[1]), {"n_words", "n_hit", "n_items", "item_ids", "contaminated"}),
    "op11": (lambda d, c, more: mixing.mix(d, c, source="a.b"), {"size", "source_size", "target", "taken"}),
    "op12": (
        lambda d, c, more: alignment.link_counts(d, c, queries.side_a, queries.side_b),
        {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    ),
    "op13": (lambda d, c, more: importance.resample(d, more[1], c), {"n_features", "weight", "score", "rank"}),
}


@pytest.fixture(scope="module")
def tables(spark):
    token = 'key token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" end'
    texts = [None, "", token, "one two three four five six seven eight nine ten eleven\nline a b c d e f", "one two", "mail a@b.org now " * 9]
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts * 3)]
    quoted = ", ".join(f"`{n}` string" for n in NAMES)
    documents = spark.createDataFrame(rows, f"doc_id long, text string, {quoted}").cache()
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(18)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    return documents, (labels, benchmark)


@pytest.mark.parametrize("name", OPERATORS)
def test_kept_columns_keep_their_values(tables, name):
    documents, more = tables
    operator, added = OPERATORS[name]
    got = operator(documents, documents.columns, more)
    lower = {a.lower() for a in added}
    assert got.columns[: len(documents.columns) - len(lower & {c.lower() for c in documents.columns})] == [
        c for c in documents.columns if c.lower() not in lower
    ]
    assert set(got.columns) >= added and len({c.lower() for c in got.columns}) == len(got.columns)
    wanted = {r["doc_id"]: r for r in documents.collect()}
    names = [c for c in documents.columns if c.lower() not in lower]
    rows = got.collect()
    assert rows and all(r[c] == wanted[r["doc_id"]][c] for r in rows for c in names)
    if name not in ("op1", "op8"):
        assert len(rows) == len(wanted)


def test_pipeline_stages_keep_odd_columns(spark, tables, monkeypatch):
    documents, (_, benchmark) = tables
    docs = documents.withColumn("n_chars", F.length("text").cast("long"))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: benchmark)
    wanted = {r["doc_id"]: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        for r in got.collect():
            assert all(r[c] == wanted[r["doc_id"]][c] for c in NAMES)
