"""Fixtures of the operator tests."""

from __future__ import annotations

import pytest


@pytest.fixture(scope="module")
def documents(spark):
    """Rows with nulls, empty and long texts, repeated rows, copies and clashing column names."""
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(80)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows = [
        (None, None), (None, passage), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"),
        (6, passage), (7, f"start {passage} end"), (8, passage), (8, passage), (9, "x " * 3000),
        (10, "é€\U0001f600 ünï\x85code text " * 4),
    ]
    for i in range(20, 60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(text))
            text[at:at] = passage.split()[: rng.randint(20, 70)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(100 + i, r[1]) for i, r in enumerate(rows[20:30])]
    frame = spark.createDataFrame(
        [(d, t, i, "score", 1.5) for i, (d, t) in enumerate(rows)],
        "doc_id long, text string, row int, words string, n_hit double",
    )
    return frame.cache()


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text, r.row) for r in documents.orderBy("row").collect()]


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.limit(0)
