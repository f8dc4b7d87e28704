"""Importance resampling against plain sums."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from brute import UPPER
from sample_rows import documents, nothing, rows  # noqa: F401

from buildlens.llm import importance

ADDED = ["n_features", "weight", "score", "rank"]


def plain_features(text, run=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return [" ".join(w[i : i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)], len(w)


def plain_resample(docs, target, share, least, run, buckets):
    """[(n_features, weight, score, rank)] for (doc_id, text) rows."""
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    held = [Counter(map(bucket, plain_features(t, run)[0])) for _, t in docs]
    s, t = Counter(), Counter()
    for h in held:
        s.update(h)
    for text in target:
        t.update(map(bucket, plain_features(text, run)[0]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for (doc, _), h in zip(docs, held):
        step = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in h.items())
        out.append([sum(h.values()), weight, weight + math.floor(-1000 * math.log(-math.log((step + 0.5) / 4294967296))), None])
    order = sorted(
        (i for i, (_, x) in enumerate(docs) if plain_features(x)[1] >= least),
        key=lambda i: (-out[i][2], docs[i][0] is not None, docs[i][0] or 0),
    )
    for place, i in enumerate(order[: len(order) * share.numerator // share.denominator]):
        out[i][3] = place + 1
    return out


@pytest.mark.parametrize(("run", "buckets", "share"), [(1, 10_000, Fraction(1, 10)), (3, 77, Fraction(1, 2))])
def test_resample_equals_plain_version(spark, documents, rows, run, buckets, share):
    docs = [(d, t) for d, t, _ in rows]
    goal = [t for _, t in docs[20:30]] + [None, "", "Only in the Target é"]
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    got = importance.resample(documents, target, ["row"], share=share, run=run, buckets=buckets, least_words=5)
    assert got.columns == ["row", *ADDED]
    want = plain_resample(docs, goal, share, 5, run, buckets)
    found = {r.row: [r[c] for c in ADDED] for r in got.collect()}
    assert [found[i][:3] for i in range(len(docs))] == [w[:3] for w in want]
    # Rows that are equal in score and id may swap places.
    key = Counter((docs[i][0], found[i][2], found[i][3]) for i in found)
    assert key == Counter((d, w[2], w[3]) for (d, _), w in zip(docs, want))


@pytest.mark.parametrize("seed", range(5))
def test_bit_planes_sum_exactly(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    gain = rng.integers(-(1 << rng.integers(1, 20)), 1 << rng.integers(1, 20), 1000)
    dense = rng.integers(0, 1 << rng.integers(1, 30), (40, 1000)) * (rng.random((40, 1000)) < 0.1)
    dense[7] = 0
    monkeypatch.setattr(importance, "BLOCK", int(rng.integers(1, 500)))
    row, bucket = np.nonzero(dense)
    got = importance.weights(row, bucket, dense[row, bucket], 40, importance.gain_planes(gain), 1000)
    assert got.tolist() == (dense @ gain).tolist()


def test_drawn_documents_are_like_the_target(spark):
    docs = [(i, " ".join((["goal", "aim"] if i % 10 == 0 else ["other", "else"]) * 20)) for i in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([("goal aim goal",)], "text string")
    drawn = importance.resample(frame, target, ["doc_id"]).where("rank IS NOT NULL").collect()
    assert sorted(r.doc_id for r in drawn) == list(range(0, 500, 10))


def test_nulls_empty_tables_and_clashing_names(spark, documents, nothing):
    none = spark.createDataFrame([], "text string")
    odd = documents.withColumnsRenamed({"words": "rank", "n_hit": "bucket", "row": "a.b"})
    got = importance.resample(odd, none, ["doc_id", "rank", "bucket", "a.b", "text"])
    assert got.columns == ["doc_id", "bucket", "a.b", "text", *ADDED]
    assert got.count() == documents.count() and got.where("text IS NULL AND weight <> 0").count() == 0
    assert importance.resample(nothing, none, ["doc_id"]).count() == 0


def test_long_text_is_linear(spark):
    text = "word " * 300_000 + "last"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = importance.resample(frame, frame, ["doc_id"]).first()
    assert row.n_features == 300_001
