"""Quality rules from repeated text, found with suffix arrays.

Every text is a sequence of words. Its suffixes are sorted by prefix doubling: a round
ranks the positions by their next 1, 2, 4, ... words, and only positions that still share
a rank go on. Ranks of all rounds give the longest common prefix of neighbouring suffixes;
the deepest interval of common prefixes around a suffix is the longest repeat that starts
there. The union of those spans (of at least `window` words) is the repeated part of a
text. The rules limit its share and the longest repeat.

Texts are handled in chunks of whole texts, all suffixes of a chunk at once; no row meets
another one, so there is no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import SPACES, map_chunks
from buildlens.llm.kept import keeping

MIN_WORDS = 20
WINDOW_WORDS = 8
BASE_REPEATED_PERCENT = 30  # of a text's words
# Limits that decide below the base rule, which lets repeats cover up to 30 % of a text's words: two
# places of a repeat as long as MAX_LONGEST allows cover 24 %.
MAX_COVERED = 0.25  # share of a text's word bytes inside its repeats
MAX_LONGEST = 0.12  # longest repeat as a share of a text's words
SYMBOLS = "#*$%&|<>"

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, covered double"
)


def repeats(ids: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Words of the longest repeat that starts at each position; 0 where it has under `least`.

    `ids` (dense, from 0) are equal for equal words of one text and differ between texts;
    `ends` is the end of each position's text. Overlapping repeats count.
    """
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n == 0:
        return longest
    counts = np.bincount(ids)
    rank = (np.cumsum(counts) - counts)[ids]  # the first place of the group in suffix order
    live = np.flatnonzero(counts[ids] > 1)
    ranks, width, wide = [rank], 1, None
    while len(live):
        if wide is None and width * 2 > least:
            wide = live  # they share at least `width` words with another position
        ahead = live + width
        follow = np.where(ahead < ends[live], rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((follow, rank[live]))
        live, follow = live[order], follow[order]
        old = rank[live]
        group = np.r_[True, old[1:] != old[:-1]]
        fresh = group | np.r_[True, follow[1:] != follow[:-1]]
        place = np.arange(len(live))
        first_old = np.maximum.accumulate(np.where(group, place, 0))
        first_new = np.maximum.accumulate(np.where(fresh, place, 0))
        rank = rank.copy()
        rank[live] = old + first_new - first_old
        ranks.append(rank)
        alone = fresh & np.r_[fresh[1:], True]
        live, width = live[~alone], width * 2
    if wide is None or len(wide) == 0:
        return longest
    order = wide[np.argsort(rank[wide], kind="stable")]
    common = _common(order[:-1], order[1:], ranks, ends)
    common[common < least] = 0
    longest[order[:-1]] = common
    np.maximum.at(longest, order[1:], common)
    return longest


def _common(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at a and b, by descending powers of two."""
    total = np.zeros(len(a), np.int64)
    a, b, n = a.copy(), b.copy(), len(ends)
    end_a, end_b = ends[a], ends[b]
    for level in range(len(ranks) - 1, -1, -1):
        rank = ranks[level]
        inside = (a < end_a) & (b < end_b)
        same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        step = np.where(same, 1 << level, 0)
        total += step
        a += step
        b += step
    return total


def covered_words(longest: np.ndarray) -> np.ndarray:
    """Whether each position lies in a span [i, i + longest[i])."""
    n = len(longest)
    at = np.flatnonzero(longest)
    reach = np.zeros(n, np.int64)
    reach[at] = at + longest[at]
    return np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)


def _chunk(texts: list, window: int) -> dict[str, object]:
    texts = ["" if t is None else t for t in texts]
    fresh = count()
    ids: list[int] = []
    sizes: list[int] = []
    lengths: list[int] = []
    out: dict[str, list] = {"n_symbols": [], "n_dup_lines": [], "word_chars": []}
    for text in texts:
        words = text.encode("utf-8", "replace").split()  # ASCII white space, as the contract has it
        number = defaultdict(fresh.__next__)
        ids += map(number.__getitem__, words)
        lengths += map(len, words)
        sizes.append(len(words))
        out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        lines = [line for line in text.split("\n") if line.strip(SPACES)] if "\n" in text else ()
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    size = np.array(sizes, np.int64)
    end = np.cumsum(size)
    start = end - size
    longest = repeats(np.array(ids, np.int64), np.repeat(end, size), window)
    inside = covered_words(longest)
    total = np.r_[0, np.cumsum(inside)]
    length = np.array(lengths, np.int64)
    chars = np.r_[0, np.cumsum(length)]
    chars_in = np.r_[0, np.cumsum(np.where(inside, length, 0))]
    most = np.zeros(len(size), np.int64)
    full = size > 0
    if full.any():
        most[full] = np.maximum.reduceat(longest, start[full])
    whole = chars[end] - chars[start]
    return out | {
        "n_words": size,
        "n_repeat_words": total[end] - total[start],
        "longest_repeat": most,
        "covered": (chars_in[end] - chars_in[start]) / np.maximum(whole, 1),
    }


def repetition_stats(documents: DataFrame, columns: list[str], window: int = WINDOW_WORDS) -> DataFrame:
    """`columns` of every row with the statistics of its whole text.

    A null text counts as empty: no words, nothing repeated.
    """
    return map_chunks(documents, columns, ["text"], lambda texts: _chunk(texts, window), STATS)


def verdict(max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST):
    """Column: whether the repeated part and the longest repeat keep to the limits."""
    return (F.col("covered") <= max_covered) & (F.col("longest_repeat") <= F.col("n_words") * max_longest)


@keeping(*[c.split()[0] for c in STATS.split(", ")], "base_failed", "kept")
def apply_rules(
    documents: DataFrame,
    columns: list[str],
    min_words: int = MIN_WORDS,
    base_percent: int = BASE_REPEATED_PERCENT,
    **limits,
) -> DataFrame:
    """`columns` of every row with the statistics, `base_failed` and `kept`.

    Null, empty and too short texts fail the base rule. Equal rows get equal results;
    an empty table gives an empty one. Kept columns may have any name.
    """
    stats = repetition_stats(documents, columns)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * base_percent)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(**limits))
