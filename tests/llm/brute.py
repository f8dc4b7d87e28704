"""Plain Python counterparts of the operators, over lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def decontaminate(docs, items, window=10):
    """{row index: (n_words, n_hit, n_items, sha)}"""
    known = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(UPPER))
        if w and item is not None:
            n = min(window, len(w))
            for s in range(len(w) - n + 1):
                known[tuple(w[s : s + n])].add(str(item))
    sizes = {len(k) for k in known}
    out = []
    for text in docs:
        w = ALNUM.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                items_ = known.get(tuple(w[s : s + n]))
                if items_:
                    hit.update(range(s, s + n))
                    found |= items_
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), sha, len(hit) > 0))
    return out


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)
    )


def longest_repeats(w, least):
    """Longest repeat starting at each position, by comparing all pairs."""
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j:
                n = 0
                while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                out[i] = max(out[i], n)
    return [n if n >= least else 0 for n in out]


def fingerprint(text):
    import xxhash

    w = words((text or "").translate(UPPER))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(docs, radius=2):
    """{index: smallest doc_id reachable} for (doc_id, fingerprint) rows, by all pairs."""
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            if (a ^ docs[j][1]).bit_count() <= radius:
                parent[top(i)] = top(j)
    best = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            best[top(i)] = min(doc, best.get(top(i), doc))
    return [best.get(top(i)) for i in range(len(docs))]


def substring_dedup(docs, window=50):
    """[(n_words, n_removed, sha of the kept words)] for (doc_id, text) rows."""
    first = {}
    cut = [(d, words(t)) for d, t in docs]
    for d, w in cut:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            f = first.get(tuple(w[i : i + window]))
            if f is not None and (d is None or f < d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def similar_lines(docs, threshold=0.8, shingle=5):
    """Indexes (row, line number) that have an earlier line of at least the similarity; docs are texts in order."""
    lines = []
    for d, text in enumerate(docs):
        for n, line in enumerate((text or "").split("\n")):
            w = words(line)
            if w:
                k = min(shingle, len(w))
                lines.append(((d, n), {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}))
    out = set()
    for i, (at, a) in enumerate(lines):
        for _, b in lines[:i]:
            if len(a & b) >= threshold * len(a | b):
                out.add(at)
                break
    return out


def base_spans(text):
    """'kind:start:end' of the fixed formats, by the plain rules."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out
