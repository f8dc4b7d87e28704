"""Removal of word sequences that stand in an earlier document, found by recompression.

A window of `window` words that also starts in a document with a smaller doc_id is a repeat;
the words it covers are removed. Windows are judged on the input.

Round 1 names runs and pairs of words, level by level (see `recompress`), and takes from each
window an anchor, a row of symbols that the window's own words settle: equal windows have
equal ones. Spark finds the names that more than one text has. Round 2 looks at the windows
whose anchors have such names, names the whole window with 95 bits, and Spark finds the
smallest doc_id of each name. Windows that some smaller document has are removed.

Equal texts are one text with the smallest of their ids from the start, so copies cost one
narrow row. Names that many texts share are only counted, with partial counts before the
shuffle; no group of texts is gathered and no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import map_chunks, small, stored
from buildlens.llm.kept import keeping
from buildlens.llm.recompress import anchors, window_names

WINDOW_WORDS = 50
# Names and lists of numbers are broadcast while their stored table is smaller than this.
NAME_BYTES = 32 << 20
# Rows without a doc_id come after all others.
LAST = (1 << 63) - 1


def _known(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, NAME_BYTES) else df


def _hashed(texts: list[list[bytes]]) -> np.ndarray:
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    ids: list[int] = []
    for words in texts:
        ids += map(number.__getitem__, words)
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
    return known[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)


def _split(texts: list) -> tuple[list[list[bytes]], np.ndarray]:
    words = [(t or "").encode("utf-8", "replace").split() for t in texts]  # ASCII white space only
    return words, np.fromiter(map(len, words), np.int64, len(words))


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.ListArray:
    """A list of the values of each row."""
    order = np.argsort(owner, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order]))


def _parse(texts: list, window: int) -> dict[str, object]:
    words, sizes = _split(texts)
    found = anchors(_hashed(words), sizes, window)
    end = np.cumsum(sizes)
    names = np.concatenate([x.names for x in found]) if found else np.zeros(0, np.uint64)
    place = np.concatenate([x.place for x in found]) if found else np.zeros(0, np.int64)
    return {
        "n_words": sizes,
        "whole_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words],
        "names": _lists(names.view(np.int64), np.searchsorted(end, place, "right"), len(sizes)),
    }


def _windows(texts: list, shared: list, window: int) -> dict[str, np.ndarray]:
    """Windows whose anchors have shared names: row, start and a 95-bit name."""
    words, sizes = _split(texts)
    hashed = _hashed(words)
    end = np.cumsum(sizes)
    known = np.unique(np.array([n for names in shared for n in names], np.int64)).view(np.uint64)
    starts = [x.windows[np.isin(x.names, known)[x.anchor]] for x in anchors(hashed, sizes, window)]
    at = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    row = np.searchsorted(end, at, "right")
    return {
        "_row": row,
        "start": at - (end - sizes)[row],
        "k1": window_names(hashed, at, window, 1).view(np.int64),
        "k2": (window_names(hashed, at, window, 2) >> np.uint64(33)).astype(np.int32),
    }


def _cut(texts: list, starts: list, window: int) -> dict[str, object]:
    words, sizes = _split(texts)
    kept, removed, spans = [], [], []
    for w, at in zip(words, starts):
        step = np.zeros(len(w) + 1, np.int64)
        at = np.array(at, np.int64)
        step[at] += 1
        step[at + window] -= 1
        gone = np.cumsum(step[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
        kept.append(b" ".join([x for x, g in zip(w, gone.tolist()) if not g]))
        removed.append(int(gone.sum()))
    return {
        "removed": removed,
        "spans": spans,
        "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
    }


@keeping("n_words", "n_removed", "spans", "kept_sha256")
def remove_repeats(documents: DataFrame, columns: list[str], window: int = WINDOW_WORDS) -> DataFrame:
    """`columns` of every row with n_words, n_removed, spans (removed words, [start, end)) and kept_sha256.

    `documents` needs doc_id and text. A null text has no words. Rows without a doc_id count as
    later than all others; rows with the same doc_id never remove from each other. Texts
    shorter than a window stay whole. Column names that are not asked for are not read.
    """
    key = ["_t1", "_t2"]
    docs = documents.select(
        *columns,
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_ord"),
        F.xxhash64("text", F.lit(1)).alias("_t1"),
        F.xxhash64(F.lit("text"), "text", F.lit(2)).alias("_t2"),
    )
    parsed = stored(
        map_chunks(
            docs, [*columns, "_ord", *key], ["text"], lambda texts: _parse(texts, window),
            "n_words long, whole_sha256 string, names array<long>",
        ),
        "parsed",
    )
    firsts = parsed.groupBy(*key).agg(F.min("_ord").alias("_ord"))
    posted = parsed.select(F.explode("names").alias("name"), *key)
    shared = stored(
        posted.groupBy("name").agg(F.min("_t1").alias("a"), F.max("_t1").alias("b")).where("a < b").select("name"),
        "shared",
    )
    candidates = stored(
        posted.join(_known(shared), "name", "left_semi").groupBy(*key).agg(F.collect_set("name").alias("names")).join(firsts, key),
        "candidates",
    )
    # A row that the table holds twice comes twice from here; sets and smallest ids do not mind.
    texts = stored(docs.select(*key, "_ord", "text").join(_known(candidates), [*key, "_ord"]), "texts")

    rows = map_chunks(
        texts, [*key, "_ord"], ["text", "names"], lambda text, names: _windows(text, names, window),
        "start int, k1 long, k2 int",
    )
    first = rows.groupBy("k1", "k2").agg(F.min("_ord").alias("low"), F.max("_ord").alias("high")).where("low < high")
    repeats = rows.join(first.select("k1", "k2", "low"), ["k1", "k2"]).where("low < _ord")
    starts = stored(repeats.groupBy(*key).agg(F.collect_set("start").alias("starts")), "starts")
    changed = texts.select(*key, "text").join(_known(starts), key)
    cut = map_chunks(
        changed, key, ["text", "starts"], lambda text, starts: _cut(text, starts, window),
        "removed long, spans array<struct<start:int,end:int>>, kept_sha256 string",
    )
    facts = stored(
        firsts.withColumnRenamed("_ord", "_first").join(cut, key, "left").where("removed is not null")
        .unionByName(
            parsed.groupBy(*key).agg(F.min("_ord").alias("_first"), F.max("_ord").alias("_last"))
            .where("_first < _last").drop("_last"), allowMissingColumns=True,
        )
        .groupBy(*key).agg(
            F.min("_first").alias("_first"), F.max("removed").alias("removed"),
            F.first("spans", True).alias("spans"), F.first("kept_sha256", True).alias("kept"),
        ),
        "facts",
    )
    joined = parsed.drop("names").join(F.broadcast(facts) if small(facts) else facts, key, "left")
    n = F.col("n_words")
    copy = (F.col("_ord") > F.coalesce("_first", F.lit(LAST))) & (n >= window)
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end")))
    return joined.select(
        *columns,
        "n_words",
        F.when(copy, n).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole_sha256")).alias("kept_sha256"),
    )
