"""Locally consistent naming of word sequences by recompression.

A round first names runs of one symbol, then pairs: a hash deals the symbols into left and
right ones, and a left symbol before a right one is named together with it. Names are hashes
of what they stand for, so the same name means the same everywhere, in every task, without
a table of names. What a symbol is called depends on few words around it: `low` and `high`
bound them. Equal word sequences therefore get equal symbols wherever those bounds lie inside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every bit."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the ordered pair."""
    return mix(mix(a) * _B + b)


# Symbols in a row that make an anchor: on the highest level that has so many in a window, they nearly fill it.
SEQUENCE = 3


@dataclass
class Level:
    """Symbols in order: their names, and the words [low, high) that settle them."""

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray


def first_level(words: np.ndarray) -> Level:
    at = np.arange(len(words))
    return Level(words, at, at + 1)


def next_level(level: Level, first: np.ndarray, last: np.ndarray, salt: int) -> tuple[Level, np.ndarray, np.ndarray]:
    """One round. `first` and `last` mark the first and last symbol of each text; names never
    cross them, and a symbol that a text's edge settles reaches past that edge."""
    name, low, high = level.name, level.low, level.high
    n = len(name)
    # Runs: a symbol differs from its neighbours, which therefore settle it too.
    begin = first.copy()
    begin[1:] |= name[1:] != name[:-1]
    at = np.flatnonzero(begin)
    stop = np.r_[at[1:], n]
    length = stop - at
    edge_l, edge_r = first[at], last[stop - 1]
    run_low = np.where(edge_l, low[at] - 1, low[at - 1])
    run_high = np.where(edge_r, high[stop - 1] + 1, high[np.minimum(stop, n - 1)])
    run = name[at]
    many = length > 1
    if many.any():
        run = run.copy()
        run[many] = join(run[many], length[many].astype(np.uint64) + np.uint64(salt << 32))
    # Pairs: left before right.
    right = (mix(run ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
    m = len(run)
    pair = np.zeros(m, bool)
    pair[:-1] = ~right[:-1] & right[1:] & ~edge_r[:-1]
    second = np.r_[False, pair[:-1]]
    nxt, prv = np.minimum(np.arange(m) + 1, m - 1), np.maximum(np.arange(m) - 1, 0)
    # A left symbol looks at the one after it, a right symbol at the one before it.
    new_low = np.where(right, np.where(edge_l, run_low - 1, run_low[prv]), run_low)
    new_high = np.where(right, run_high, np.where(edge_r, run_high + 1, run_high[nxt]))
    new_low = np.minimum(new_low, run_low)
    new_high = np.maximum(new_high, run_high)
    out = np.flatnonzero(~second)
    joined = pair[out]
    named = run[out].copy()
    a = out[joined]
    named[joined] = join(run[a], run[a + 1] + np.uint64(salt))
    low_out, high_out = new_low[out].copy(), new_high[out].copy()
    low_out[joined] = run_low[a]
    high_out[joined] = run_high[a + 1]
    first_out = edge_l[out]
    last_out = np.where(joined, edge_r[np.minimum(out + 1, m - 1)], edge_r[out])
    return Level(named, low_out, high_out), first_out, last_out


@dataclass
class Anchored:
    """Windows by their starts, and the anchor of each (an index into `names`).

    `place` is a word inside each anchor's bounds, which tells its text.
    """

    names: np.ndarray
    place: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray


def anchors(words: np.ndarray, sizes: np.ndarray, window: int) -> list[Anchored]:
    """An anchor for every window: a sequence of symbols that lie, with their bounds, inside it.

    `words` holds the hashed words of several texts of `sizes`. A window's level is the highest
    one with SEQUENCE symbols inside it, or without such a level the highest with one; words
    settle themselves, so every window has some. Of the rows of SEQUENCE neighbouring symbols in
    a window (of all its symbols, if they are fewer), the one with the smallest name is the
    anchor. All of this depends on the window's words alone, not on the texts beside it: equal
    windows have anchors of equal names in every call.
    """
    n = len(words)
    end = np.cumsum(sizes)
    start = end - sizes
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = sizes > 0
    first[start[full]] = True
    last[end[full] - 1] = True
    before, behind = start[full] - 1, end[full] + 1
    open_ = np.flatnonzero(np.arange(n) + window <= np.repeat(end, sizes))
    levels = [first_level(words)]
    while len(open_):
        level, first, last = next_level(levels[-1], first, last, len(levels))
        # One word past the edge is outside every window; bounds stay sorted over all texts.
        text = np.cumsum(first) - 1
        level = Level(level.name, np.maximum(level.low, before[text]), np.minimum(level.high, behind[text]))
        a, b = _inside(level, open_, window)
        if not (b > a).any():
            break
        levels.append(level)
    out = []
    for least in (SEQUENCE, 1):
        for depth in range(len(levels) - 1, -1, -1):
            if not len(open_):
                break
            level = levels[depth]
            a, b = _inside(level, open_, window)
            size = np.minimum(b - a, SEQUENCE)
            name = mix(level.name ^ np.uint64(depth))
            for q in range(1, SEQUENCE + 1):
                if q > 1:  # the name of the q symbols from each one on
                    name = join(name[:-1], level.name[q - 1 :])
                of = size == q
                if q >= least and of.any():
                    used, number = np.unique(_least(name, a[of], b[of] - q + 1), return_inverse=True)
                    out.append(Anchored(name[used], level.low[used], open_[of], number))
            open_ = open_[size < least]
    return out


def _inside(level: Level, open_: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols [a, b) that lie, with their bounds, in each window."""
    return np.searchsorted(level.low, open_, "left"), np.searchsorted(level.high, open_ + window, "right")


def _least(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the smallest value in each range [a, b), the leftmost of equal ones."""
    best = np.arange(len(value))
    tables, width = [best], 1
    most = int((b - a).max())
    while width * 2 <= most:
        left, right = best[: len(value) - 2 * width + 1], best[width : len(value) - width + 1]
        best = np.where(value[left] <= value[right], left, right)
        tables.append(best)
        width *= 2
    out = np.empty(len(a), np.int64)
    power = np.frexp((b - a).astype(np.float64))[1] - 1
    for p in range(len(tables)):
        at = np.flatnonzero(power == p)
        if len(at):
            left, right = tables[p][a[at]], tables[p][b[at] - (1 << p)]
            out[at] = np.where(value[left] <= value[right], left, right)
    return out


def window_names(words: np.ndarray, at: np.ndarray, window: int, salt: int) -> np.ndarray:
    """64-bit names of the windows that start at `at`, from names of power-of-two blocks."""
    block, width, offset = mix(words ^ mix(np.full(1, salt, np.uint64))), 1, 0
    out = np.zeros(len(at), np.uint64)
    while True:
        if window & width:
            out = join(out, block[at + offset])
            offset += width
        if width * 2 > window:
            return out
        block = np.r_[join(block[:-width], block[width:]), block[len(block) - width :]]
        width *= 2
