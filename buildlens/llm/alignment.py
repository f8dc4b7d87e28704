"""Aligning the tokens of two tokenizers by interval coalescing, and counting linked ids.

Tokens of both sides are byte ranges of one string. Sorted by start, a group ends where the next
start reaches the largest end so far; all tokens whose ranges overlap, directly or by way of
others, so share a group. Every A token of a group is linked with every B token of it.

How many documents hold an id pair is counted over the corpus from partial counts. Then each
document looks its own pairs up: pairs that more than one in HOT_PAIRS of all documents' pairs
equal are fewer than HOT_PAIRS, so they go to every task as sorted arrays; the rest have no
frequent key and meet their counts in a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from buildlens.llm.common import map_chunks, stored
from buildlens.llm.kept import Kept
from buildlens.llm.packing import PATTERN, byte_vocabulary

SHIFT = 32  # an id pair is one number: the A id above these bits, the B id below
# Pairs that are looked up in memory: 17 bytes each in every Python task.
HOT_PAIRS = 1 << 18
# So many pairs of a group's distinct ids are spelled out at once.
BLOCK = 1 << 22


@dataclass
class Side:
    """A tokenizer: ids of texts, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    spelled: list[bytes]

    def __post_init__(self):
        self.lengths = np.array([len(b) for b in self.spelled], np.int64)


_SIDES: dict[str, Side] = {}


def byte_level(path: str) -> Side:
    """Byte-level BPE of a tokenizer file (JSON); special tokens in a text are plain text."""
    if path not in _SIDES:
        import tiktoken

        ranks, _ = byte_vocabulary(path)
        encoding = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            spelled[i] = token
        _SIDES[path] = Side(lambda texts: [encoding.encode_ordinary(" " + t) for t in texts], spelled)
    return _SIDES[path]


def pieces(path: str) -> Side:
    """A sentencepiece model with byte fallback, which puts the space before a text itself."""
    if path not in _SIDES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        _SIDES[path] = Side(lambda texts: model.encode(texts, num_threads=1), spelled)
    return _SIDES[path]


def groups(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): tokens sorted by start (side after it), and the group of each in that order."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    first = np.ones(len(order), bool)
    first[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(first) - 1


def _linked(group: np.ndarray, ids: np.ndarray, n_groups: int) -> tuple[np.ndarray, ...]:
    """Distinct ids of each group and how often each stands there: (group's first place, ids, times)."""
    keys, times = np.unique((group << SHIFT) | ids, return_counts=True)
    first = np.searchsorted(keys >> SHIFT, np.arange(n_groups + 1))
    return first, keys & ((1 << SHIFT) - 1), times


def pairs_of_groups(
    group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, owner: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, links): for each owner of groups its distinct id pairs, and how many links each has.

    Ids that repeat within a group are multiplied, not spelled out. Blocks of groups bound the memory.
    """
    n = len(owner)
    first_a, a, times_a = _linked(group_a, a, n)
    first_b, b, times_b = _linked(group_b, b, n)
    width = np.diff(first_b)
    fan = width[np.repeat(np.arange(n), np.diff(first_a))]  # B ids that each A id meets
    of_a = np.repeat(np.arange(n), np.diff(first_a))
    ends = np.cumsum(fan)
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(a):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        meets = fan[at:upto]
        left = np.repeat(np.arange(at, upto), meets)
        step = np.arange(len(left)) - np.repeat(np.cumsum(meets) - meets, meets)
        right = first_b[of_a[left]] + step
        out.append(_summed(owner[of_a[left]], (a[left] << SHIFT) | b[right], times_a[left] * times_b[right]))
        at = upto
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    if len(out) == 1:
        return out[0]
    return _summed(*[np.concatenate(part) for part in zip(*out)])


def _summed(owner: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each owner and pair, with the sum of links."""
    order = np.lexsort((pair, owner))
    owner, pair, links = owner[order], pair[order], links[order]
    first = np.ones(len(pair), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(first)
    return owner[at], pair[at], np.add.reduceat(links, at) if len(at) else links


def align_texts(texts: list, side_a: Side, side_b: Side) -> dict[str, object]:
    """The columns of `align` for a chunk of texts."""
    n = len(texts)
    full = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = side_a.encode([texts[i] for i in full]), side_b.encode([texts[i] for i in full])
    good, tokens_a, tokens_b, size = [], [], [], []
    for i, xs, ys in zip(full, ids_a, ids_b):
        raw = b" " + texts[i].encode()
        if b"".join(map(side_a.spelled.__getitem__, xs)) == raw and b"".join(map(side_b.spelled.__getitem__, ys)) == raw:
            good.append(i)
            tokens_a.append(xs)
            tokens_b.append(ys)
            size.append(len(raw))
    count_a, count_b = [np.array([len(x) for x in t], np.int64) for t in (tokens_a, tokens_b)]
    a, b = [np.array([i for x in t for i in x], np.int64) for t in (tokens_a, tokens_b)]
    # Documents lie one behind the other on one line of bytes, so no group spans two of them.
    end = np.concatenate([np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b])])
    start = end - np.concatenate([side_a.lengths[a], side_b.lengths[b]])
    side = np.repeat(np.array([0, 1], np.int8), [len(a), len(b)])
    order, group = groups(start, end, side)
    n_groups = int(group[-1]) + 1 if len(group) else 0
    of = np.empty(len(order), np.int64)
    of[order] = group
    group_a, group_b = of[: len(a)], of[len(a) :]
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    last_group = group_a[np.cumsum(count_a) - 1] if good else np.zeros(0, np.int64)
    per_doc = np.diff(last_group, prepend=-1)
    owner = np.repeat(np.arange(len(good)), per_doc)
    held, pair, links = pairs_of_groups(group_a, a, group_b, b, owner)
    places = np.searchsorted(held, np.arange(len(good) + 1))
    all_links = np.concatenate([[0], np.cumsum(in_a * in_b)])
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    digests = _digests(a, b, group_a, group_b, count_a, count_b)

    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    rows = np.array(good, np.int64)
    out["n_a"][rows], out["n_b"][rows], out["n_groups"][rows] = count_a, count_b, per_doc
    out["n_links"][rows] = all_links[bounds[1:]] - all_links[bounds[:-1]]
    sha = [""] * n
    offsets = np.zeros(n + 1, np.int32)
    for k, i in enumerate(good):
        sha[i] = digests[k]
        offsets[i + 1] = places[k + 1] - places[k]
    offsets = np.cumsum(offsets).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (pair, links)]
    return {**out, "groups_sha256": sha, "pairs": lists[0], "times": lists[1]}


_TEXTS: dict[tuple[int, str], list[str]] = {}


def _numbers(size: int, mark: str) -> list[str]:
    """Decimal ids, each with the mark that stands behind it."""
    if (size, mark) not in _TEXTS:
        _TEXTS[size, mark] = [f"{i}{mark}" for i in range(size)]
    return _TEXTS[size, mark]


def _digests(
    a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray
) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3` for each document, groups in order."""
    if not len(a):
        return []
    sides = []
    for ids, group, mark in ((a, group_a, "|"), (b, group_b, ";")):
        closes = np.append(group[1:] != group[:-1], True)
        size = int(ids.max()) + 1
        texts = _numbers(1 << size.bit_length(), ",") + _numbers(1 << size.bit_length(), mark)
        sides.append((ids + closes * (1 << size.bit_length()), texts))
    # A group's A tokens come before its B tokens: merge both streams by group.
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    codes = np.empty(len(a) + len(b), np.int64)
    codes[place_a] = sides[0][0]
    codes[place_b] = sides[1][0] + len(sides[0][1])
    texts = sides[0][1] + sides[1][1]
    ends = np.cumsum(count_a + count_b)
    out, at = [], 0
    for end in ends.tolist():
        joined = "".join(map(texts.__getitem__, codes[at:end].tolist()))
        out.append(hashlib.sha256(joined[:-1].encode()).hexdigest())
        at = end
    return out


def align(documents: DataFrame, keep: list[str], side_a: Callable[[], Side], side_b: Callable[[], Side]) -> DataFrame:
    """Stored: `keep` columns (inner names) with token and group counts, and each document's distinct id pairs.

    Both sides are given as functions, which open the tokenizer in the task that needs it.
    """

    def run(texts: list) -> dict[str, object]:
        return align_texts(texts, side_a(), side_b())

    added = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return map_chunks(documents, keep, ["text"], run, added)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, documents, best): how many documents link a pair, and whether no pair of its A id has more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            pair, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counted = aligned.select("pairs").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("documents"))
    # An A id has at most as many pairs as B has ids, whatever the corpus.
    of_a = Window.partitionBy(F.shiftright("pair", SHIFT))
    return counted.withColumn("best", F.col("documents") == F.max("documents").over(of_a))


def link_counts(
    documents: DataFrame, keep: list[str], side_a: Callable[[], Side], side_b: Callable[[], Side], hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """`keep` columns of every row with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    count_sum adds over the links of a document how many documents hold the link's id pair; n_best
    counts the links whose pair is, with ties, the one that most documents hold of its A id.

    A text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens:
    its counts are 0 and its digest is empty. Rows are documents of their own, repeated ones too. An
    empty table gives an empty one. Kept columns may have any name; added ones replace those of theirs.
    """
    kept = Kept(keep)
    read = kept.take(documents, text=F.col("text"))
    aligned = stored(
        align(read, kept.inner, side_a, side_b).withColumn("row", F.monotonically_increasing_id()), "aligned"
    )
    counts = stored(pair_counts(aligned), "pair-counts")
    total, n = counts.agg(F.sum("documents"), F.count("*")).first()
    # Fewer than `hot_pairs` pairs can hold more than this part of all; with few pairs all are looked up.
    least = 0 if n <= hot_pairs else total // hot_pairs
    hot = counts.where(F.col("documents") > least).toPandas().sort_values("pair")  # at most hot_pairs rows
    table = aligned.sparkSession.sparkContext.broadcast(
        (hot["pair"].to_numpy(np.int64), hot["documents"].to_numpy(np.int64), hot["best"].to_numpy(bool))
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, documents_, best = table.value
        for batch in batches:
            lists = batch.column("pairs")
            pair = lists.flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            weight = np.where(known, times, 0)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            if len(keys):
                np.add.at(sums[0], row, weight * documents_[at])
                np.add.at(sums[1], row, weight * best[at])
            cold = ~known
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[cold], minlength=batch.num_rows))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(
                pa.array(ends), pa.StructArray.from_arrays([pa.array(pair[cold]), pa.array(times[cold])], names=["pair", "times"])
            )
            kept_columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(
                [*kept_columns, pa.array(sums[0]), pa.array(sums[1]), rest],
                names=[*batch.schema.names[:-2], "count_sum", "n_best", "rest"],
            )

    plain = [c for c in aligned.columns if c not in ("pairs", "times")]
    sums = StructType.fromDDL("count_sum long, n_best long, rest array<struct<pair: long, times: long>>")
    schema = StructType([*aligned.select(*plain).schema.fields, *sums.fields])
    found = aligned.select(*plain, "pairs", "times").mapInArrow(look_up, schema)
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least == 0:
        return kept.give(found, added)
    found = stored(found, "links-found")
    rare = found.select("row", F.explode("rest").alias("link")).select("row", "link.pair", "link.times")
    sums = rare.join(counts.where(F.col("documents") <= least), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("documents")).alias("more_sum"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
    )
    both = found.join(sums, "row", "left").fillna(0, ["more_sum", "more_best"])
    both = both.withColumn("count_sum", F.col("count_sum") + F.col("more_sum"))
    return kept.give(both.withColumn("n_best", F.col("n_best") + F.col("more_best")), added)
