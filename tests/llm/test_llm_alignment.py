"""Token alignment against a plain version that compares every byte offset."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sample_rows import documents, nothing, rows  # noqa: F401
from tokenizers import Tokenizer

from buildlens.llm import alignment, queries

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    "<|endoftext|> plain", "a▁b", "  two  spaces", "<s> </s> <0x41>", "naïve ﬁ １２３ 日本語 \U0001f600\U0001f600", "tab\t\n\n\nend ",
    "a" * 700, "\x00\x01", "don't we'll", " ", "é" * 40,
]


@pytest.fixture(scope="module")
def known():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def spelled_a(tokenizer, ids):
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return [bytes(table[c] for c in tokenizer.id_to_token(i)) for i in ids]


def spelled_b(model, ids):
    out = []
    for i in ids:
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def brute(texts, known):
    groups = []
    for text in texts:
        found = []
        if text:
            a = known[0].encode(" " + text, add_special_tokens=False).ids
            b = known[1].encode(text)
            pa, pb = spelled_a(known[0], a), spelled_b(known[1], b)
            raw = b" " + text.encode()
            if b"".join(pa) == raw == b"".join(pb):
                ends = [{sum(map(len, p[: i + 1])): i + 1 for i in range(len(p))} for p in (pa, pb)]
                i = j = 0
                for x in sorted(set(ends[0]) & set(ends[1])):
                    found.append((a[i : ends[0][x]], b[j : ends[1][x]]))
                    i, j = ends[0][x], ends[1][x]
        groups.append(found)
    held = Counter()
    for found in groups:
        held.update({(x, y) for a, b in found for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for found in groups:
        links = [(x, y) for a, b in found for x in a for y in b]
        sha = hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in found).encode())
        out.append((
            sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(links),
            sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha.hexdigest() if found else "",
        ))
    return out


@pytest.fixture(scope="module")
def mixed(spark, rows):
    rng = random.Random(3)
    texts = [t for _, t, _ in rows] + HARD + [" ".join(rng.choices(HARD, k=4)) for _ in range(40)]
    table = [(i % 50 if i % 7 else None, t, i, i * 2) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(table, "doc_id long, text string, row int, n_links int").repartition(5).cache()


@pytest.mark.parametrize("hot_pairs", [1 << 18, 40, 1])
def test_alignment_equals_brute_force(mixed, known, hot_pairs):
    texts, frame = mixed
    got = alignment.link_counts(frame, ["row", "doc_id"], queries.side_a, queries.side_b, hot_pairs)
    assert got.columns == ["row", "doc_id", *COLUMNS]
    want = brute(texts, known)
    for r in got.collect():
        assert tuple(r[c] for c in COLUMNS) == want[r.row], texts[r.row]


def test_kept_columns_may_clash(mixed):
    _, frame = mixed
    odd = frame.withColumnsRenamed({"doc_id": "pairs", "row": "a.b"}).withColumn("k0", frame.n_links)
    got = alignment.link_counts(odd, ["pairs", "a.b", "n_links", "k0", "text"], queries.side_a, queries.side_b)
    assert got.columns == ["pairs", "a.b", "k0", "text", *COLUMNS]
    assert {(r["a.b"], r["k0"]) for r in got.collect()} == {(r.row, r.n_links) for r in frame.collect()}


def test_empty_table(nothing):
    assert alignment.link_counts(nothing, ["doc_id"], queries.side_a, queries.side_b).count() == 0


def test_blocks_do_not_change_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    group_a, group_b = np.sort(rng.integers(0, 60, 500)), np.sort(rng.integers(0, 60, 400))
    a, b = rng.integers(0, 9, 500), rng.integers(0, 9, 400)
    owner = np.repeat(np.arange(12), 5)
    whole = alignment.pairs_of_groups(group_a, a, group_b, b, owner)
    want = Counter()
    for g, x in zip(group_a, a):
        for y in b[group_b == g]:
            want[int(owner[g]), int(x) << 32 | int(y)] += 1
    assert {(o, p): n for o, p, n in zip(*[v.tolist() for v in whole])} == dict(want)
    monkeypatch.setattr(alignment, "BLOCK", 7)
    for one, other in zip(whole, alignment.pairs_of_groups(group_a, a, group_b, b, owner)):
        assert one.tolist() == other.tolist()
