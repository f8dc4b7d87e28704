"""Operators against plain Python, on rows with nulls, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib

import brute
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from sample_rows import documents, nothing, rows  # noqa: F401

from buildlens.llm import (
    common, decontamination, line_dedup, pii, quality_rules, recompress, simhash, substring_dedup,
)


def by_row(df):
    return {r.row: r for r in df.collect()}


def test_fingerprints_and_components(spark, documents, rows, nothing):
    got = by_row(simhash.near_duplicates(documents, ["doc_id", "row", "words"]))
    prints = [(d, brute.fingerprint(t)) for d, t, _ in rows]
    for (d, t, row), (_, fp), component in zip(rows, prints, brute.components(prints)):
        assert got[row].fp % (1 << 64) == fp
        assert got[row].component_id == component
        assert got[row].words == "score"
    assert simhash.near_duplicates(nothing, ["doc_id"]).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    masks = simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(500):
        flips = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("radius, pairwise", [(2, 48), (2, 1), (1, 1), (3, 1)])
def test_links_connect_what_all_pairs_connect(spark, radius, pairwise):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    values = {b for b in base}
    for b in base:
        for _ in range(40):
            values.add(b ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 5)), replace=False)))
    values = sorted(values)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.links(nodes, radius, pairwise)
    assert all((r.a ^ r.b).bit_count() <= radius for r in links.collect())
    root = {r.node: r.root for r in common.components(links, "test").collect()}
    want = brute.components([(v, v) for v in values], radius)
    assert [root.get(v, v) for v in values] == want


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)}
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def plain_repetition(text):
    """(longest repeat, share of the words' bytes inside repeats) by comparing all pairs of places."""
    words = brute.words(text)
    longest = brute.longest_repeats(words, quality_rules.WINDOW_WORDS)
    inside = {j for i, n in enumerate(longest) for j in range(i, i + n)}
    sizes = [len(w.encode()) for w in words]
    return max(longest, default=0), sum(sizes[j] for j in inside) / max(sum(sizes), 1)


def test_the_verdict_decides_where_the_base_rule_does_not(spark):
    def text(n, repeat, times):
        words = [f"w{i}" for i in range(n)]
        return " ".join(words + words[:repeat] * (times - 1))

    cases = [(text(60, 0, 1), True, False), (text(52, 8, 2), False, False), (text(200, 20, 2), True, False),
             (text(150, 21, 2), False, False), (text(120, 10, 3), True, False), (text(60, 20, 3), False, True), (text(50, 8, 3), False, True)]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(frame, ["doc_id"]).collect()}
    for i, (t, kept, failed) in enumerate(cases):
        longest, covered = plain_repetition(t)
        assert (got[i].longest_repeat, got[i].covered) == (longest, pytest.approx(covered))
        assert (got[i].kept, got[i].base_failed) == (kept, failed), (i, longest, covered)


def test_rules(spark, documents, rows, nothing):
    got = by_row(quality_rules.apply_rules(documents, ["row", "words"]))
    for _, text, row in rows:
        r = got[row]
        base = brute.rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        longest, covered = (r.longest_repeat, r.covered) if base[0] > 400 else plain_repetition(text)
        assert r.longest_repeat == longest and r.covered == pytest.approx(covered)
        limits = covered <= quality_rules.MAX_COVERED and longest <= quality_rules.MAX_LONGEST * base[0]
        assert r.kept == (not r.base_failed and limits)
    assert quality_rules.apply_rules(nothing, ["row"]).count() == 0


def test_suffix_order_finds_the_longest_repeats():
    rng = np.random.default_rng(0)
    for least in (2, 3, 8):
        texts = [rng.integers(0, k, n).tolist() for k in (1, 2, 3) for n in (0, 1, 2, 7, 40)]
        ids, sizes, base = [], [], 0
        for t in texts:
            used = sorted(set(t))
            ids += [base + used.index(x) for x in t]
            base += len(used)
            sizes.append(len(t))
        ends = np.repeat(np.cumsum(sizes), sizes)
        got = quality_rules.repeats(np.array(ids, np.int64), ends, least)
        assert got.tolist() == [n for t in texts for n in brute.longest_repeats(t, least)]


@pytest.mark.parametrize("window", [50, 8])
def test_substring_dedup(spark, documents, rows, nothing, window):
    got = by_row(substring_dedup.remove_repeats(documents, ["row", "words"], window))
    for (_, text, row), want in zip(rows, brute.substring_dedup([(d, t) for d, t, _ in rows], window)):
        r = got[row]
        assert (r.n_words, r.n_removed, r.kept_sha256) == want
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert substring_dedup.remove_repeats(nothing, ["row"]).count() == 0


@pytest.mark.parametrize("window", [4, 13, 50])
def test_equal_windows_have_equal_anchors(window):
    rng = np.random.default_rng(window)
    words = recompress.mix(rng.integers(0, 3, 3000).astype(np.uint64))
    words[200:400] = words[0]  # a run longer than a window
    words[1000:1300] = words[2000:2300]
    sizes = np.array([700, 0, 900, window, 1, 1399 - window])
    names = {}
    found = recompress.anchors(words, sizes, window)
    ends = np.cumsum(sizes)
    seen = 0
    for x in found:
        for start, anchor in zip(x.windows, x.anchor):
            key = words[start : start + window].tobytes()
            assert names.setdefault(key, x.names[anchor]) == x.names[anchor]
            seen += 1
    assert seen == sum(max(0, n - window + 1) for n in sizes) and ends[-1] == len(words)


@pytest.mark.parametrize("window", [2, 8, 50])
def test_anchors_do_not_depend_on_the_texts_beside_them(window):
    rng = np.random.default_rng(window)
    draw = lambda n: recompress.mix(rng.integers(0, 1000, n).astype(np.uint64))
    text = draw(600)

    def named(parts):
        sizes = np.array([len(p) for p in parts])
        at = int(sizes[: next(i for i, p in enumerate(parts) if p is text)].sum())
        got = {}
        for x in recompress.anchors(np.concatenate(parts), sizes, window):
            got |= {int(w) - at: x.names[k] for w, k in zip(x.windows, x.anchor) if at <= w < at + len(text)}
        return got

    alone = named([text])
    assert len(alone) == len(text) - window + 1
    short = [draw(8) for _ in range(4000)]
    assert named([*short[:2000], text, *short[2000:]]) == alone
    assert named([draw(5000), text, draw(20), draw(3000)]) == alone


def test_line_dedup(spark, documents, rows, nothing):
    got = by_row(line_dedup.deduplicate(documents, ["row", "words"]))
    # Rows in the operator's order; equal rows share a place, so the first of them stands for all.
    ranked = documents.select(
        "row", "doc_id", "text", F.dense_rank().over(
            Window.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        ).alias("place"),
    ).collect()
    texts = {r.place: r.text for r in ranked}
    gone = brute.similar_lines([texts[p] for p in sorted(texts)])
    order = {p: i for i, p in enumerate(sorted(texts))}
    for r in ranked:
        assert got[r.row].removed == sorted(n for d, n in gone if d == order[r.place])
        assert got[r.row].n_lines == sum(bool(brute.words(x)) for x in (r.text or "").split("\n"))
    assert line_dedup.deduplicate(nothing, ["row"]).count() == 0


def test_line_dedup_of_a_group_of_variants(spark):
    line = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*line[: i % 40], f"z{i}", *line[i % 40 + 1 :]])) for i in range(60)]
    shared = " ".join(line[:12])
    rows += [(100 + i, shared + " " + " ".join(f"u{i}x{k}" for k in range(40))) for i in range(30)]
    got = {r.doc_id: r.removed for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    gone = brute.similar_lines([t for _, t in rows])
    assert got == {d: [0] if (i, 0) in gone else [] for i, (d, _) in enumerate(rows)}


def test_line_dedup_ranks_the_rows_of_a_token_once(spark, monkeypatch):
    plans = []

    def spy(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return common.stored(df, label)

    monkeypatch.setattr(line_dedup, "stored", spy)
    shared = " ".join(f"w{i}" for i in range(30))
    rows = [(i, shared + " " + " ".join(f"u{i}x{k}" for k in range(6))) for i in range(14)]
    rows.append((20, "\t" + rows[13][1].replace(" ", " \x0b ") + "\r\n \x0c\nanother"))
    twice = spark.createDataFrame(rows + rows, "doc_id long, text string")
    got = line_dedup.deduplicate(twice, ["doc_id"]).collect()
    gone = brute.similar_lines([t for _, t in rows])
    at = {d: i for i, (d, _) in enumerate(rows)}
    assert len(got) == 2 * len(rows)
    for r in got:
        assert r.removed == sorted(n for i, n in gone if i == at[r.doc_id])
        assert r.n_lines == (2 if r.doc_id == 20 else 1)
    assert (at[20], 0) in gone
    assert sum("Window" in p for p in plans) == 1


def test_line_dedup_leaves_tokens_of_one_line_out_of_the_first_block(spark, monkeypatch):
    plans = {}

    def spy(df, label):
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString())
        return common.stored(df, label)

    monkeypatch.setattr(line_dedup, "stored", spy)
    near = [f"v{i}" for i in range(40)]
    rows = [(1, " \t" + " ".join(near)), (2, "first\n\n" + "  ".join(near[1:])), (3, "\r\n" + " ".join(near[2:] + ["x"]) + "\nlast")]
    rows += [(4, "alone"), (5, ""), (6, None)]
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert {r.doc_id: r.removed for r in got} == {1: [], 2: [2], 3: [1], 4: [], 5: [], 6: []}
    gone = brute.similar_lines([t for _, t in rows])
    assert all(r.removed == sorted(n for i, n in gone if i == r.doc_id - 1) for r in got)
    ranks, firsts = plans["ranked"].rindex("row_number"), plans["ranked"].rindex("nth_value")
    assert firsts < plans["ranked"].index("Filter (size") < ranks


def test_without_lines(spark):
    df = spark.createDataFrame([("a\nb\n\nc", [1]), ("a", []), (None, []), ("x\ny", [0, 1])], "t string, r array<int>")
    assert [r[0] for r in df.select(line_dedup.without_lines(F.col("t"), F.col("r"))).collect()] == ["a\n\nc", "a", None, ""]


def test_decontamination(spark, documents, rows, nothing):
    passage = next(t for d, t, _ in rows if d == 6)
    items = [
        (1, passage[:200]), (2, "one two"), (3, None), (4, ""), (5, " ".join(passage.split()[5:20]).upper()), (6, "ünï"),
        (6, "x x x x x x x x x x x"), (7, "nowhere in the texts at all"), (None, "one"), (8, "one"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_row(decontamination.decontaminate(documents, bench))
    for (_, text, row), want in zip(rows, brute.decontaminate([t for _, t, _ in rows], items)):
        r = got[row]
        sha = hashlib.sha256(",".join(r.item_ids).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, sha, r.contaminated) == want
        assert r.words == "score" and isinstance(r.n_hit, int)  # a column of an added name is replaced
    assert decontamination.decontaminate(nothing, bench).count() == 0
    assert not by_row(decontamination.decontaminate(documents, bench.limit(0)))[0].contaminated


def test_personal_data(spark, documents, rows, nothing):
    texts = [
        "mail a.b+c@x-y.example.com, 10.0.0.255 and 1.2.3.4.5.6.7.8", "300.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112",
        "+1 (017) 555-7713 x +49 30 1234567890123456 ++1 2 3", "a@b@c.d.e", "é 4111111111111111é", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i].base] == brute.base_spans(t or "")
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))
    assert pii.find(nothing, ["doc_id"]).count() == 0
    shown = df.join(pii.find(df, ["doc_id"]), "doc_id").where("doc_id = 4").select(pii.redact(F.col("text"), F.col("base"))).first()[0]
    assert shown == "é [card]é"


def test_personal_data_learns_looser_writing():
    rng = np.random.default_rng(0)
    x, y = [], []
    for i in range(600):
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        digits += next(str(k) for k in range(10) if pii.luhn(digits + str(k)))
        if i % 2:
            digits = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        text = "card " + ".".join(digits[k : k + 4] for k in range(0, 16, 4)) + " end"
        x.append(pii.features(2, text, 5, 24))
        y.append(1 - i % 2)
    trees = pii.boost(np.array(x[:400]), np.array(y[:400], float))
    right = (trees.probability(np.array(x[400:])) > 0.5) == np.array(y[400:], bool)
    assert right.mean() > 0.95


def test_personal_data_of_a_rare_kind_beside_a_hot_source(spark):
    rng = np.random.default_rng(4)

    def address(good):
        parts = rng.integers(1, 250, 4)
        parts[1] += 0 if good else 300
        return ".".join(map(str, parts))

    rows = [f"the host {address(i % 2)} answers" for i in range(200)]
    loose = "the host 10[.]20[.]30[.]40 answers"
    hot = [" ".join(f"mail {n}x{i}@site{i % 7}.example.com now" for n in range(20)) for i in range(1500)]
    found = {}
    for name, texts in (("alone", [*rows, loose]), ("hot", [*rows, loose, *hot])):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        model = pii.fit(df, 1000)
        found[name] = model.extra([loose], [[]])[0]
        assert model.thresholds[1] <= 1
    assert found["hot"] == found["alone"] == [(1, 9, 26)]


def personal_texts(n, seed):
    """(text, kind, span) with one span of a kind in prose, in a fixed format."""
    rng = np.random.default_rng(seed)
    words = "the of and a day was then under which people house river green until never some".split()
    for i in range(n):
        kind = i % 4
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        span = (
            f"{rng.choice(words)}.{rng.choice(words)}{i}@site{i % 17}.example.org", ".".join(map(str, rng.integers(1, 256, 4))),
            digits + next(str(k) for k in range(10) if pii.luhn(digits + str(k))), f"+49 {rng.integers(100, 999)} {rng.integers(1000000, 9999999)}",
        )[kind]
        hint = (["mail", "contact"], ["host", "server"], ["card", "visa"], ["call", "phone"])[kind][i % 2]
        yield f"{' '.join(rng.choice(words, 8))} {hint}", kind, span, " ".join(rng.choice(words, 8))


def test_loose_writing_is_found_by_kind_and_look_alikes_are_left(spark):
    base = [f"{a} {span} {b}" for a, _, span, b in personal_texts(1200, 1)]
    planted, others = [], []
    for i, (a, kind, span, b) in enumerate(personal_texts(240, 2)):
        loose = pii._loosened(kind, span, i)
        planted.append((kind, f"{a} {loose} {b}", len(a) + 1, len(a) + 1 + len(loose)))
        neutral = " ".join(a.split()[:-1]) + " " + pii._OTHERWISE[kind][i % 3]
        others.append((kind, f"{neutral} {loose} {b}", len(neutral) + 1, len(neutral) + 1 + len(loose)))
    model = pii.fit(spark.createDataFrame(list(enumerate(base)), "doc_id long, text string"))
    assert (model.thresholds <= 1).all()
    shares = {}
    for name, rows in (("found", planted), ("taken", others)):
        texts = [t for _, t, _, _ in rows]
        extra = model.extra(texts, [pii.base_spans(t) for t in texts])
        for kind in range(4):
            mine = [(r, e) for r, e in zip(rows, extra) if r[0] == kind]
            hits = [any(k == kind and s < r[3] and r[2] < t for k, s, t in e) or r[1][r[2] : r[3]] in [r[1][s:t] for _, s, t in pii.base_spans(r[1])] for r, e in mine]
            shares[name, kind] = sum(hits) / len(hits)
    for kind in range(4):
        assert shares["found", kind] >= 0.9, shares
        assert shares["taken", kind] <= 0.2, shares


def test_taken_places_against_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(50):
        spans = [(0, int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, 6), rng.integers(1, 12, 6))]
        places, kept = pii._Places(spans), list(spans)
        for a, n in zip(rng.integers(0, 70, 40).tolist(), rng.integers(1, 6, 40).tolist()):
            free = not any(x < a + n and a < y for _, x, y in kept)
            assert places.holds(a, a + n) == free
            if free:
                places.add(a, a + n)
                kept.append((0, a, a + n))


def test_sample_draws_small_groups_whole():
    assert pii.quotas({"a": 5, "b": 1000, "c": 70}, 150) == {"a": 5, "c": 70, "b": 75}
    assert pii.quotas({"a": 5, "b": 6}, 150) == {"a": 5, "b": 6}
    assert sum(pii.quotas({k: 10**6 for k in range(7)}, 20_000).values()) == 20_000


def test_personal_data_learn_from_every_candidate(spark, monkeypatch):
    """A few thousand of the rows that a small weight stood for change the model, and they weigh no more than it says."""
    texts = [f"{a} {span} {b}" for a, _, span, b in personal_texts(400, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, grow = [], pii.grow

    def noted(edges, share, total_of):
        def total(*state):
            sums = total_of(*state)
            seen.append(sums[..., 2].sum() / len(edges) / pii.UNIT)
            return sums

        return grow(edges, share, total)

    monkeypatch.setattr(pii, "grow", noted)
    monkeypatch.setattr(pii, "TREES", 2)
    examples = [e for t in texts for e in pii.examples(t)]
    assert len(examples) > 1000
    counted = []
    vectors = pii._vectors
    monkeypatch.setattr(pii, "_vectors", lambda *a: counted.append(vectors(*a)) or counted[-1])
    pii.fit(df, 160)
    assert counted[0].agg(F.sum("n")).first()[0] == len(examples)
    assert 80 < min(seen) and max(seen) < 160 and max(seen) - min(seen) < 1e-3


def test_quantiles_of_counted_values_and_histograms_in_parts():
    rng = np.random.default_rng(6)
    for n in (1, 2, 40, 1000):
        c = rng.integers(0, 50, n) / 4
        want = np.unique(np.quantile(c, np.linspace(0, 1, pii.BINS + 1)[1:-1]))
        assert np.allclose(pii.weighted_quantiles(*np.unique(c, return_counts=True)), want)
    x, y = rng.integers(0, 9, (500, 3)).astype(float), rng.integers(0, 2, 500).astype(float)
    edges = [np.unique(c)[:-1] for c in x.T]
    b, w = pii.binned_by(edges, x), rng.random(500)
    grown = [(np.array([0, 1, 2, 0, 1, 2, 0]), np.array([3, 2, 255, 5, 1, 7, 2]), rng.normal(size=8))]
    state = (0.1, grown, (np.array([1, 0, 2, 0, 0, 0, 0]), np.array([4, 2, 3, 255, 255, 255, 255])), 2)
    whole = pii.histograms(b, y, w, *state)
    assert (whole == pii.histograms(b[:100], y[:100], w[:100], *state) + pii.histograms(b[100:], y[100:], w[100:], *state)).all()
    assert (whole.sum(axis=(0, 2)) == whole.sum(axis=(0, 2))[0]).all()
