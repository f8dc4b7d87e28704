from __future__ import annotations

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from buildlens.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def test_every_stage_against_plain_python(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing",
    ]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality_rules"](spark, docs, SF_DIR).cache()
    assert kept.columns == columns
    for d, r in rows.items():
        n, _, _, _, repeated = brute.rules(r.text)
        if n < 20 or 100 * repeated > 30 * n:
            assert kept.where(F.col("doc_id") == d).count() == 0

    cut = stage["line_dedup"](spark, kept, SF_DIR).cache()
    assert cut.columns == columns and cut.count() == kept.count()
    before = sorted((r.doc_id, r.text) for r in kept.collect())
    gone = brute.similar_lines([t for _, t in before])
    want = {
        d: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, (d, t) in enumerate(before)
    }
    assert {r.doc_id: r.text for r in cut.collect()} == want

    single = stage["simhash_near_dedup"](spark, cut, SF_DIR).cache()
    assert single.columns == columns
    prints = [(d, brute.fingerprint(t)) for d, t in want.items()]
    assert {r.doc_id for r in single.collect()} == set(brute.components(prints))

    clean = stage["benchmark_decontamination"](spark, single, SF_DIR).cache()
    left = [(r.doc_id, r.text) for r in single.collect()]
    judged = brute.decontaminate([t for _, t in left], items)
    assert {r.doc_id for r in clean.collect()} == {d for (d, _), j in zip(left, judged) if not j[4]}

    packed = stage["best_fit_packing"](spark, clean, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_stages_take_nulls_ties_and_nothing(spark):
    docs = table(spark, SF_DIR, "documents")
    text = docs.first().text
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, "", "en", "s", 0), (None, text, "en", "s", 5)],
        docs.schema,
    )
    for given in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, given, SF_DIR)
            if name != "best_fit_packing":
                assert got.columns == docs.columns
            got.count()
