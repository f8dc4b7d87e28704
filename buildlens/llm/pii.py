"""Personal data: fixed formats always, and further candidates that boosted trees accept.

The base formats (email, ip, card, phone) are exact rules. Around them, generators with high
recall propose spans in looser writing: addresses with "(at)" and "dot", numbers in other
separators, phone numbers without a plus. Candidates may overlap. Gradient-boosted trees
judge them by format (digits, groups, separators, checks) and context (neighbouring
characters and words). They learn from the corpus itself: base spans, as found and rewritten
in looser formats, are positive. Negative are candidates that break a check of their kind (Luhn
sum, parts over 255, number of digits, ending of a host), and for every base span the same looser
writing and a look-alike that passes the checks, both behind a word that says it is something else (a
version, an order number, a date). On a third of the candidates that is held out, the threshold
of each kind is set to the least score with the wanted precision; the rows of all kinds take part
with the weight of POOLED_ROWS rows, so a rare kind leans on the others. Accepted candidates that overlap no base span are added, the
likeliest first; nothing is checked behind the trees.

Training reads every candidate. They weigh as `fit_candidates` rows in all, shared by kind and
label: those of a kind and label with no more than an even part of them weigh one each, whatever
else the corpus is full of, and the larger ones share what is left evenly. Features become bins
at their weighted quantiles, equal rows of bins are counted, and each level of a tree adds up the
histograms of its nodes in Spark.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import map_chunks, stored
from buildlens.llm.kept import keeping

KINDS = ("email", "ip", "card", "phone")
FIT_CANDIDATES = 20_000
PRECISION = 0.98
# Held-out rows of all kinds count as so many rows of each kind when its threshold is set.
POOLED_ROWS = 10.0
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.2, 32, 20.0

# Base formats. Starts are bound to places where a leftmost match can begin, and runs never
# give characters back, so long runs cost one pass; the matches are those of the plain rules.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Looser formats.
_AT = re.compile(r"@|\x20?[(\[{](?:at|AT)[)\]}]\x20?|\x20(?:at|AT)\x20")
_DOT = r"(?:\x20?[(\[{](?:dot|DOT)[)\]}]\x20?|\x20(?:dot|DOT)\x20|\.)"
_LOOSE_HOST = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+")
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,4}(?:(?:[\[(]\.[\])]|\.)[0-9]{1,4}){3}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]){9,15}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9](?:[\x20().-]{0,2}[0-9]){6,15}(?![0-9])")


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str, at: re.Pattern, host: re.Pattern) -> list[tuple[int, int]]:
    """Spans around each mark that joins a name and a host, leftmost and not overlapping."""
    out, free = [], 0
    for m in at.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and start >= free and (h := host.match(text, m.end())):
            out.append((start, h.end()))
            free = h.end()
        else:
            free = max(free, m.end() if m.group() == "@" else free)
    return out


_PLAIN_AT = re.compile("@")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the fixed formats, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text, _PLAIN_AT, _HOST)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in any format the generators know; spans may overlap."""
    out = [(0, a, b) for a, b in _emails(text, _AT, _LOOSE_HOST)]
    for kind, pattern in ((1, _LOOSE_IP), (2, _LOOSE_CARD), (3, _LOOSE_PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def broken(kind: int, text: str) -> bool:
    """Whether a candidate fails the check of its kind in any writing."""
    digits = _digits(text)
    if kind == 0:
        ending = re.split(r"[^A-Za-z0-9-]+", text)[-1]
        return len(ending) < 2 or ending.isdigit()
    if kind == 1:
        return any(int(p) > 255 for p in re.findall(r"[0-9]+", text))
    if kind == 2:
        return not luhn(digits)
    return not 9 <= len(digits) <= 15 or len(set(digits)) < 3


_HINTS = {
    0: ("mail", "contact", "write"), 1: ("ip", "host", "addr", "server"),
    2: ("card", "visa", "credit", "pay"), 3: ("tel", "phone", "call", "fax", "mobil"),
}
# Words in front of numbers and names that only look like personal data.
_OTHERWISE = {
    0: ("look", "meet", "arrive"), 1: ("version", "release", "build", "section"),
    2: ("order", "serial", "isbn", "invoice"), 3: ("part", "date", "order", "account"),
}
N_FEATURES = 21


def features(kind: int, text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate, over the characters beside it."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits = _digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    words = re.findall(r"[A-Za-z]+", span)
    gaps = re.findall(r"[^0-9A-Za-z]+", span)
    near = before.lower()
    return [
        *[float(kind == k) for k in range(4)],
        float(len(span)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(len(set(digits))), float(len(gaps)), float(len(set(gaps))), float(max(map(len, gaps), default=0)),
        float(len(words)), float(len(words[-1]) if words else 0),
        float(luhn(digits)) if digits else 0.0,
        float(max((int(g) for g in re.findall(r"[0-9]{1,9}", span)), default=0) <= 255),
        float(any(h in near for h in _HINTS[kind])), float(any(h in near for h in _OTHERWISE[kind])),
        float(before[-1:].isalnum()) + 2 * float(after[:1].isalnum()),
        float(span[:1] in "+(") + 2 * float(span.startswith("00")),
    ]


def _loosened(kind: int, span: str, turn: int) -> str:
    """A base span in a looser writing of its kind."""
    if kind == 0:
        at, dot = ((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "."))[turn % 3]
        name, _, host = span.partition("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", ("[.]", "(.)")[turn % 2])
    if kind == 2:
        d = _digits(span)
        return (".", "_", "/")[turn % 3].join(d[i : i + 4] for i in range(0, len(d), 4))
    return (span[1:], "00" + span[1:], span[1:].replace(" ", "."))[turn % 3]


def examples(text: str) -> list[tuple[int, int, list[float]]]:
    """(kind, label, features) of the candidates whose label is known."""
    found = base_spans(text)
    base = set(found)
    out = []
    for c in candidates(text):
        if c in base:
            out.append((c[0], 1, features(c[0], text, c[1], c[2])))
        elif broken(c[0], text[c[1] : c[2]]) and not any(a < c[2] and c[1] < b for _, a, b in found):
            out.append((c[0], 0, features(c[0], text, c[1], c[2])))
    for turn, (kind, a, b) in enumerate(found):
        left, right = text[max(0, a - 30) : a], text[b : b + 20]
        loose = _loosened(kind, text[a:b], turn + a)
        out.append((kind, 1, features(kind, left + loose + right, len(left), len(left) + len(loose))))
        # The same writings behind a word that says they are something else.
        word = _OTHERWISE[kind][(turn + a) % len(_OTHERWISE[kind])]
        other = _without_hints(kind, left).rstrip(" :=") + f" {word} "
        for span in (loose, _alike(kind, turn + a)):
            out.append((kind, 0, features(kind, other + span + right, len(other), len(other) + len(span))))
    return out


def _without_hints(kind: int, before: str) -> str:
    for hint in _HINTS[kind]:
        before = re.sub(hint, "", before, flags=re.IGNORECASE)
    return before


def _alike(kind: int, turn: int) -> str:
    """Something in the writing of a kind, in range and with a right check digit, that is none."""
    a, b, c = turn % 9 + 1, turn % 23 + 1, turn % 87 + 10
    if kind == 0:
        return f"noon at number{b} dot {c}"
    if kind == 1:
        return f"{a}.{b}.{turn % 40}.{turn % 7}"
    if kind == 2:
        digits = f"97{8 + turn % 2}{turn * 7919 % 10**12:012d}"
        return digits + next(str(k) for k in range(10) if luhn(digits + str(k)))
    return (f"20{c}-{b % 12 + 1:02d}-{turn % 28 + 1:02d} {b:02d}.{c % 60:02d}", f"00{c}{turn * 7919 % 10**7:07d}")[turn % 2]


@dataclass
class Trees:
    """Boosted regression trees of the logistic loss; complete binary trees of fixed depth."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2**DEPTH - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def weighted_quantiles(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Distinct inner quantiles of distinct sorted values; with whole weights those of the repeated values."""
    reach = np.cumsum(weight)
    at = np.linspace(0, 1, BINS + 1)[1:-1] * max(reach[-1] - 1, 0)
    low, high = (value[np.minimum(np.searchsorted(reach, t, "right"), len(value) - 1)] for t in (np.floor(at), np.floor(at) + 1))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def binned_by(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)


# Sums are taken of whole numbers of this size, so they are exact and do not depend on their order.
UNIT = 2.0**30
_NO_SPLIT = 255


def _walk(binned: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for _ in range(levels):
        node = 2 * node + 1 + (binned[rows, feature[node]] > split[node])
    return node


def _raw(binned: np.ndarray, base: float, grown: list[tuple]) -> np.ndarray:
    """Sum of the trees (feature, split, value), whose splits are numbers of bins."""
    total = np.full(len(binned), base)
    for feature, split, value in grown:
        total += value[_walk(binned, feature, split, DEPTH) - (2**DEPTH - 1)]
    return total


def histograms(binned: np.ndarray, y: np.ndarray, weight: np.ndarray, base: float, grown: list[tuple], tree: tuple, level: int) -> np.ndarray:
    """Sums of gradient, curvature and weight by node of a level, feature and bin, in whole units."""
    p = 1 / (1 + np.exp(-_raw(binned, base, grown)))
    node = _walk(binned, *tree, level) - (2**level - 1)
    parts = [np.rint(UNIT * weight * v) for v in (p - y, np.maximum(p * (1 - p), 1e-6), 1.0)]
    out = np.zeros((2**level, binned.shape[1], BINS, 3))
    for j in range(binned.shape[1]):
        at = node * BINS + binned[:, j]
        for k, part in enumerate(parts):
            out[:, j, :, k] = np.bincount(at, part, 2**level * BINS).reshape(-1, BINS)
    return out


def grow(edges: list[np.ndarray], share: float, total_of) -> Trees:
    """Second-order boosting; `total_of(base, grown, tree, level)` gives the `histograms` of all rows."""
    model = Trees(float(np.log(share / (1 - share))))
    grown: list[tuple] = []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        feature, split, cut = np.zeros(inner, np.int64), np.full(inner, _NO_SPLIT), np.full(inner, np.inf)
        value = np.zeros(inner + 1)
        for level in range(DEPTH):
            for i, sums in enumerate(total_of(model.base, grown, (feature, split), level) / UNIT):
                at = 2**level - 1 + i
                whole = sums[0].sum(axis=0)
                best, sides = (1e-6, 0, 0), (whole, np.zeros(3))
                if whole[2] >= 2 * LEAST_LEAF:
                    for j, e in enumerate(edges):
                        left = np.cumsum(sums[j], axis=0)[: len(e)]
                        right = whole - left
                        gain = left[:, 0] ** 2 / (left[:, 1] + 1) + right[:, 0] ** 2 / (right[:, 1] + 1) - whole[0] ** 2 / (whole[1] + 1)
                        gain[(left[:, 2] < LEAST_LEAF) | (right[:, 2] < LEAST_LEAF)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), j, int(gain.argmax()))
                            sides = (left[best[2]], right[best[2]])
                if best[0] > 1e-6:
                    feature[at], split[at], cut[at] = best[1], best[2], edges[best[1]][best[2]]
                if level == DEPTH - 1:
                    value[2 * i : 2 * i + 2] = [-RATE * g / (h + 1) for g, h, _ in sides]
        grown.append((feature, split, value))
        model.trees.append((feature, cut, value))
    return model


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees of rows at hand, each of weight one."""
    edges = [weighted_quantiles(*np.unique(c, return_counts=True)) for c in x.T]
    binned, weight = binned_by(edges, x), np.ones(len(y))
    return grow(edges, (y.sum() + 0.5) / (len(y) + 1), lambda *state: histograms(binned, y, weight, *state))


@dataclass
class Model:
    trees: Trees
    thresholds: np.ndarray  # by kind; above 1: the kind adds nothing

    def extra(self, texts: list[str], found: list[list[tuple]]) -> list[list[tuple[int, int, int]]]:
        """Accepted candidates of each text that overlap neither a base span nor a likelier one.

        Taken places are kept as sorted disjoint spans, so a candidate costs a search and not a
        comparison with every span.
        """
        where, rows = [], []
        if (self.thresholds <= 1).any():
            for i, (text, base) in enumerate(zip(texts, found)):
                free = _Places(base)
                for kind, a, b in candidates(text):
                    if self.thresholds[kind] <= 1 and free.holds(a, b):
                        where.append((i, kind, a, b))
                        rows.append(features(kind, text, a, b))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if rows:
            score = self.trees.probability(np.array(rows))
            taken = [_Places([]) for _ in texts]
            for k in sorted(range(len(where)), key=lambda k: (-score[k], where[k])):
                i, kind, a, b = where[k]
                if score[k] >= self.thresholds[kind] and taken[i].holds(a, b):
                    taken[i].add(a, b)
                    out[i].append((kind, a, b))
        return out


class _Places:
    """Spans of a text that are taken; those given at first may overlap."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def holds(self, a: int, b: int) -> bool:
        """Whether [a, b) is free."""
        at = bisect.bisect_left(self.starts, b)
        return at == 0 or self.ends[at - 1] <= a

    def add(self, a: int, b: int) -> None:
        at = bisect.bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def quotas(sizes: dict, bound: int) -> dict:
    """What each group weighs: as many as it has for the small ones, and equally many for the others.

    They are `bound` at most in all, or all there are."""
    out, left = {}, bound
    for n, (group, size) in enumerate(sorted(sizes.items(), key=lambda s: (s[1], s[0]))):
        out[group] = min(size, left // (len(sizes) - n))
        left -= out[group]
    return out


# Distinct rows of bins that a task adds up, and the tasks that do so at most.
PASS_ROWS, PASS_TASKS = 100_000, 24
# Thresholds are looked for among so many steps of the score.
SCORE_STEPS = 1 << 16


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), N_FEATURES)


def _vectors(known: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(kind, label, held, bins, n): how many candidates have the same bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(-1, N_FEATURES)
            bins = pa.array([row.tobytes() for row in binned_by(edges, x)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], bins], names=["kind", "label", "held", "bins"])

    rows = known.select("kind", "label", "held", "x").mapInArrow(run, "kind int, label int, held boolean, bins binary")
    return stored(rows.groupBy("kind", "label", "held", "bins").agg(F.count(F.lit(1)).alias("n")), "pii-vectors")


def _trees(taught: DataFrame, edges: list[np.ndarray], share: float, weights: dict) -> Trees:
    """Trees of the counted rows of bins; a pass adds up one level's histograms, one row of each task."""

    def total_of(base: float, grown: list[tuple], tree: tuple, level: int) -> np.ndarray:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2**level, N_FEATURES, BINS, 3))
            for batch in batches:
                kind, label, n = (batch.column(i).to_pylist() for i in range(3))
                weight = np.array([weights[k, y] * c for k, y, c in zip(kind, label, n)])
                total += histograms(_matrix(batch.column(3)), np.array(label, float), weight, base, grown, tree, level)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = taught.mapInArrow(over, "sums binary").collect()  # one row of each task
        return sum(np.frombuffer(r["sums"]) for r in parts).reshape(2**level, N_FEATURES, BINS, 3)

    return grow(edges, share, total_of)


def _score_steps(held: DataFrame, edges: list[np.ndarray], trees: Trees) -> tuple[np.ndarray, np.ndarray]:
    """(least score, candidates by kind and label) of each step of the score, the highest first."""
    # A feature's bin stands for all values in it, as the cuts are edges.
    inside = [np.r_[e, e[-1:] + 1] if len(e) else np.zeros(1) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch.column(3))
            x = np.stack([values[bins[:, j]] for j, values in enumerate(inside)], axis=1)
            score = pa.array(trees.probability(x) if len(x) else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], score], names=["kind", "label", "n", "score"])

    scored = held.mapInArrow(run, "kind int, label int, n long, score double")
    groups = [(k, y) for k in range(len(KINDS)) for y in (0, 1)]
    counts = [F.sum(F.when((F.col("kind") == k) & (F.col("label") == y), F.col("n")).otherwise(0)) for k, y in groups]
    steps = scored.groupBy(F.floor(F.col("score") * SCORE_STEPS).alias("step")).agg(
        F.min("score").alias("score"), F.array(*counts).alias("n")
    )
    rows = sorted(steps.collect(), key=lambda r: -r["step"])  # at most SCORE_STEPS
    return np.array([r["score"] for r in rows]), np.array([r["n"] for r in rows], float).reshape(len(rows), len(KINDS), 2)


def fit(documents: DataFrame, fit_candidates: int = FIT_CANDIDATES, precision: float = PRECISION) -> Model:
    """Trees and thresholds from all candidates whose label is known; `fit_candidates` is what they weigh in all."""

    def run(texts: list) -> dict[str, object]:
        found = [(i, *e) for i, t in enumerate(texts) for e in examples(t or "")]
        return {
            "_row": [f[0] for f in found], "kind": [f[1] for f in found],
            "label": [f[2] for f in found], "x": [f[3] for f in found],
        }

    known = map_chunks(documents, ["doc_id"], ["text"], run, "kind int, label int, x array<double>")
    hashed = F.xxhash64("doc_id", "kind", "label", F.to_json("x"))
    known = stored(known.select("kind", "label", "x", (F.pmod(hashed, F.lit(3)) == 1).alias("held")), "pii-candidates")
    counted = known.groupBy("kind", "label", "held").count().collect()  # 16 rows
    sizes: dict[tuple[int, int], int] = {}
    for r in counted:
        sizes[r["kind"], r["label"]] = sizes.get((r["kind"], r["label"]), 0) + r["count"]
    weights = {g: n / sizes[g] for g, n in quotas(sizes, fit_candidates).items()}
    nothing = Model(Trees(), np.full(len(KINDS), 2.0))
    taught = {(r["kind"], r["label"]): r["count"] * weights[r["kind"], r["label"]] for r in counted if not r["held"]}
    if len({y for _, y in taught}) < 2:
        return nothing
    share = (sum(w for (_, y), w in taught.items() if y) + 0.5) / (sum(taught.values()) + 1)
    edges = _edges(known.where("NOT held"), weights)
    vectors = _vectors(known, edges).select("kind", "label", "n", "bins", "held")
    tasks = min(PASS_TASKS, 1 + vectors.count() // PASS_ROWS)
    trees = _trees(vectors.where("NOT held").drop("held").coalesce(tasks), edges, share, weights)
    score, n = _score_steps(vectors.where("held").drop("held"), edges, trees)
    thresholds = nothing.thresholds.copy()
    # The rows of a kind, and those of all kinds with little weight: a rare kind leans on the others.
    every = n.sum(axis=1)
    for k in sorted({kind for kind, _ in sizes}):
        part = n[:, k] + every * POOLED_ROWS / (every.sum() or 1.0)
        right = np.cumsum(part[:, 1]) / np.cumsum(part.sum(axis=1))
        good = np.flatnonzero(right >= precision)
        if len(good):
            thresholds[k] = max(float(score[good[-1]]), 0.5)
    return Model(trees, thresholds)


def _edges(known: DataFrame, weights: dict) -> list[np.ndarray]:
    """Edges of each feature's bins, from how often each of its values comes up."""
    of = F.create_map(*[x for (k, y), w in weights.items() for x in (F.lit(2 * k + y), F.lit(w))])
    counts = known.select("kind", "label", F.posexplode("x").alias("feature", "value")).groupBy("kind", "label", "feature", "value").count()
    weighed = counts.groupBy("feature", "value").agg(F.sum(F.col("count") * of[F.col("kind") * 2 + F.col("label")]).alias("weight"))
    values = weighed.orderBy("feature", "value").toPandas()  # lengths, counts and marks: as many as a feature has values
    return [weighted_quantiles(v["value"].to_numpy(), v["weight"].to_numpy()) for _, v in values.groupby("feature")]


@keeping("base", "spans")
def find(documents: DataFrame, columns: list[str], fit_candidates: int = FIT_CANDIDATES) -> DataFrame:
    """`columns` of every row with `base` and `spans`: arrays of (kind, start, end) in code points, end
    exclusive, ordered by kind and start. A null text is empty and has none; repeated rows get equal
    spans; an empty table gives an empty one. Kept columns may have any name."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, fit_candidates))

    def run(texts: list) -> dict[str, object]:
        texts = [t or "" for t in texts]
        base = [base_spans(t) for t in texts]
        more = shared.value.extra(texts, base)
        name = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        return {"base": [name(b) for b in base], "spans": [name(sorted(b + m)) for b, m in zip(base, more)]}

    span = "array<struct<kind:string,start:int,end:int>>"
    return map_chunks(documents, columns, ["text"], run, f"base {span}, spans {span}")


def redact(text, spans, mask: str = "[{}]"):
    """SQL column: the text with each span replaced by its kind; of overlapping spans the first one counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        start,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.format_string(mask.replace("{}", "%s"), s["kind"])).alias("out"),
                s["end"].alias("at"),
            )
        ),
    )
    return F.concat(done["out"], F.substr(text, done["at"] + 1))


def number(spans, kind: str):
    """SQL column: how many spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def joined(spans):
    """SQL column: kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
