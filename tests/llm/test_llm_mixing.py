"""Mixing against a plain version that goes through each source's documents one by one."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from sample_rows import documents, nothing, rows  # noqa: F401

from buildlens.llm import mixing

ADDED = ["size", "source_size", "target", "taken"]


def plain_targets(sizes, weights, share=1.5, most=2.0):
    """Water-filling, one round of resharing after the other."""
    rest, open_, out = share * sum(sizes.values()), set(sizes), {}
    while True:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if rest * weights[s] / total > most * sizes[s]}
        if not full:
            return out | {s: rest * weights[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ -= full
        rest -= sum(out[s] for s in full)


def plain_mix(docs, weights=(5, 2, 1), tolerance=0.001, seed="mix"):
    """[taken] for (doc_id, source, text) rows with different ids."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in docs]
    by = defaultdict(list)
    for i, (_, s, _) in enumerate(docs):
        by[s].append(i)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    given = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    sizes = {s: sum(size[i] for i in at) for s, at in by.items()}
    target = plain_targets(sizes, given)
    taken = [0] * len(docs)
    for s, at in by.items():
        copies = min(2.0, target[s] / sizes[s]) if sizes[s] else 0.0
        whole = math.floor(copies)
        for i in at:
            taken[i] = whole * size[i]
        gap = target[s] - whole * sizes[s]
        if copies == whole:
            continue
        line = [(int(hashlib.sha256(f"{seed}:{docs[i][0]}".encode()).hexdigest()[:13], 16), docs[i][0], i) for i in at if size[i]]
        open_, first = sorted(line), True
        while open_ and (first or gap > tolerance * target[s]):
            first, upto, behind, fits = False, 0, [], [x for x in open_ if size[x[2]] <= gap]
            for k, (h, d, i) in enumerate(fits):
                if upto + size[i] > gap:
                    behind = fits[k:]
                    break
                upto += size[i]
                taken[i] += size[i]
            gap -= upto
            open_ = behind
    return target, taken


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    docs = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "Z", "", None, "one"]) if i > 5 else f"only{i}"
        n = rng.choice([0, 1, 3, 20, 20, 60, 400 if i % 50 == 0 else 30])
        docs.append((i, source, rng.choice([" ", "\n ", "\t"]).join(["w"] * n) if i % 90 else None))
    frame = spark.createDataFrame([(*d, rng.random() * 3) for d in docs], "doc_id long, source string, text string, worth double")
    return docs, frame.repartition(7).cache()


def test_mix_equals_plain_version(corpus):
    docs, frame = corpus
    target, taken = plain_mix(docs)
    got = {r.doc_id: r for r in mixing.mix(frame, ["doc_id", "source"]).collect()}
    assert len(got) == len(docs)
    for (i, source, _), want in zip(docs, taken):
        assert got[i].target == pytest.approx(target[source], rel=1e-12) and got[i].taken == want
        assert got[i].taken <= 2 * got[i].size
    again = {r.doc_id: r.taken for r in mixing.mix(frame.repartition(3), ["doc_id"]).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_sources_come_near_their_targets(corpus):
    _, frame = corpus
    sums, sizes = defaultdict(int), defaultdict(int)
    got = mixing.mix(frame, ["source"]).collect()
    for r in got:
        sums[r.source, r.target] += r.taken
        sizes[r.source] = max(sizes[r.source], r.size)
    for (source, target), n in sums.items():
        assert n <= target + 1e-6 and target - n <= max(0.02 * target, 1)
    assert sum(t for _, t in sums) == pytest.approx(1.5 * sum(r.size for r in got))


def test_importance_gives_unequal_chances(corpus):
    docs, frame = corpus
    hits, runs = defaultdict(int), 2
    for seed in range(runs):
        for r in mixing.mix(frame, ["doc_id", "source", "worth"], importance="worth", seed=str(seed)).where("source = 'hot'").collect():
            assert r.taken in (0, r.size, 2 * r.size)
            if r.size:
                hits[min(int(r.worth), 2)] += r.taken / r.size
                hits["n", min(int(r.worth), 2)] += 1
    rates = [hits[k] / hits["n", k] for k in range(3)]
    assert rates[0] < rates[1] < rates[2] and rates[1] / rates[0] > 2


def test_inclusion_chances_are_those_wanted(spark):
    """Documents of one size: over many seeds each is drawn about as often as its odds say."""
    worth = [0.2, 0.5, 0.8] * 60
    frame = spark.createDataFrame([(i, "s", "w", w) for i, w in enumerate(worth)], "doc_id long, source string, text string, worth double")
    n, hits = 3, defaultdict(float)
    for seed in range(n):
        for r in mixing.mix(frame, ["worth"], importance="worth", share=0.5, seed=f"c{seed}").collect():
            hits[r.worth] += r.taken / 60 / n
    for w in (0.2, 0.5, 0.8):
        assert hits[w] == pytest.approx(w, abs=0.12)


def test_nulls_repeats_clashing_names_and_no_rows(documents, nothing, rows):
    odd = documents.withColumnsRenamed({"words": "source", "n_hit": "taken"}).withColumn("z.at", documents.row)
    got = mixing.mix(odd, ["doc_id", "taken", "z.at", "text", "source"])
    assert got.columns == ["doc_id", "z.at", "text", "source", *ADDED]
    assert sorted(r["z.at"] for r in got.collect()) == [r for _, _, r in rows]
    assert mixing.mix(nothing, ["doc_id"], source="words").count() == 0
    blank = documents.select("doc_id").selectExpr("doc_id", "cast(null as string) text", "cast(null as string) source")
    assert {tuple(r) for r in mixing.mix(blank, []).collect()} == {(0, 0, 0.0, 0)}


def test_weights_by_table(spark, corpus):
    docs, frame = corpus
    given = spark.createDataFrame([("hot", 1.0), ("a", 3.0), (None, 1.0)], "source string, weight double")
    got = {r.source: r.target for r in mixing.mix(frame, ["source"], weights=given, share=0.1).collect()}
    assert got["a"] == pytest.approx(3 * got["hot"]) and got[None] == got["hot"] and got["b"] == 0
