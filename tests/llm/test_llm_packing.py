from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from sample_rows import documents, nothing, rows  # noqa: F401
from tokenizers import Tokenizer

from buildlens.llm import packing
from buildlens.llm.queries import packed, tokenizer_path

PATH = tokenizer_path()
HARD = ["", " ", "a\x00b", "don't DON'T we're", "  x  \n\n y\t", "é́ \x85 ३४ \U0001f600", "<|endoftext|> in a text", "a" * 5000]


def test_ids_are_those_of_the_tokenizer_file():
    known = Tokenizer.from_file(PATH)
    texts = HARD + [" ".join(random.Random(i).choices(HARD, k=5)) for i in range(50)]
    assert packing.encode(texts, PATH) == [known.encode(t, add_special_tokens=False).ids for t in texts]


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_round_trip(spark, documents, rows):
    got = packing.pack(documents, ["row"], PATH, capacity=64).collect()
    check_sequences(got, 64)
    known = Tokenizer.from_file(PATH)
    pieces = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        pieces[r.row].append(r)
    assert set(pieces) == {r for _, _, r in rows}
    for _, text, row in rows:
        mine = sorted(pieces[row], key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist()
        assert ids == known.encode(text or "", add_special_tokens=False).ids + [0]
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1].tolist()]
        assert all(r.length == 64 for r in mine[1:])


def test_empty_table_and_repeated_ids(spark, documents, nothing):
    assert packed(nothing, PATH).count() == 0
    assert packed(documents, PATH).count() >= documents.count()


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, rng.integers(1, 400))
    counts = np.bincount(lengths, minlength=101)
    plan = packing.plan_sequences(counts, 100)
    used = np.zeros(101, int)
    for parts, times in plan:
        assert sum(parts) <= 100
        for p in parts:
            used[p] += times
    assert (used == counts).all()
    number = sum(t for _, t in plan)
    assert number <= max(1, int(np.ceil(lengths.sum() / 100 * 1.15)) + 1)


def test_exact_complements_leave_no_gap():
    counts = np.zeros(2049, int)
    for n in (1000, 1048, 700, 648, 400, 300):
        counts[n] = 50
    plan = packing.plan_sequences(counts)
    assert sum(t for _, t in plan) == 100


def optimum(lengths, capacity):
    """Fewest sequences, by trying every place of every piece."""
    best = len(lengths)

    def place(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for gap in set(gaps):
            if gap >= lengths[i]:
                k = gaps.index(gap)
                place(i + 1, gaps[:k] + [gap - lengths[i]] + gaps[k + 1 :])
        place(i + 1, [*gaps, capacity - lengths[i]])

    place(0, [])
    return best


def test_plans_are_near_the_optimum():
    rng = np.random.default_rng(4)
    made = least = 0
    for _ in range(150):
        lengths = sorted(rng.integers(1, 21, rng.integers(1, 10)).tolist(), reverse=True)
        number = sum(t for _, t in packing.plan_sequences(np.bincount(lengths, minlength=21), 20))
        best = optimum(lengths, 20)
        assert best <= number <= best + 1
        made, least = made + number, least + best
    assert made <= 1.02 * least
