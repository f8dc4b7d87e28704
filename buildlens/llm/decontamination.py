"""Benchmark decontamination: a prefix-filtered set join of shingles.

A benchmark item is cut into windows of `window` consecutive words (a shorter item is
one window). A window is a sequence of word shingles, so a text can hold it only if it
holds the window's rarest shingle; that one shingle is the prefix that must be joined.
Rarity is the number of times the corpus holds the shingle. A joined position fixes
where the window would start: it must lie inside the text (length bound), every other
shingle must stand at its own distance (positional bound), and the words themselves are
compared at the end, so a hash never decides.

Only SQL functions run here. The corpus text is read once; what leaves that scan are
the places that hold some benchmark shingle, each with the few words around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import lower_ascii, small, stored, words_of

WINDOW_WORDS = 10
# Places of a text that are looked at together.
BLOCK = 64
SHINGLE_WORDS = 3
# Word breaks of the contract: ASCII characters that are neither digits nor letters.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
# The same words before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _shingle(words, at, size: int):
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def _shingles(words, size: int):
    """Hashes of the word shingles by position."""
    last = F.size(words) - size
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _shingle(words, i, size))
    ).otherwise(F.array().cast("array<bigint>"))


def _blocks(words, size: int, reach: int):
    """For every BLOCK places of shingles: first, last, and the words from `from` on that any window there needs."""
    last = F.size(words) - size

    def block(first):
        start = F.greatest(first - reach, F.lit(0))
        upto = F.least(first + (BLOCK - 1), last)
        return F.struct(
            first.alias("first"), upto.alias("last"), start.alias("from"),
            F.slice(words, start + 1, upto + (reach + size) - start).alias("words"),
        )

    firsts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(BLOCK)), lambda x: x <= last)
    return F.transform(firsts, block)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(n, words, items): the distinct windows of all items that have a word."""
    words = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"),
        words_of(lower_ascii(F.col("text")), BREAKS).alias("w"),
    ).where("item_id is not null and size(w) > 0")
    cut = words.select(
        "item_id",
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"),
        "w",
    ).select("item_id", F.slice("w", F.col("s") + 1, window).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item_id").alias("items")).select(
        F.size("words").alias("n"), "words", "items"
    )


def find_windows(documents: DataFrame, windows: DataFrame, key: list[str], shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(key, n_words, start, n, items): where a text holds a window, verified word by word.

    `key` names the columns that tell the rows of `documents` apart; it must hold `text`'s
    words in column `w`.
    """
    windows = stored(windows, "windows")
    sizes = [r[0] for r in windows.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect()]  # at most `shingle` rows
    found = [_find(documents, windows.where(F.least("n", F.lit(shingle)) == k), key, k) for k in sorted(sizes)]
    if not found:
        return documents.where(F.lit(False)).select(
            *key, F.lit(0).alias("start"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("items")
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _find(documents: DataFrame, windows: DataFrame, key: list[str], k: int) -> DataFrame:
    longest = windows.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    of_window = stored(
        windows.select("words", "n", F.posexplode(_shingles(F.col("words"), k)).alias("at", "h")), "shingles"
    )
    vocabulary = stored(of_window.select("h").distinct(), "shingle-set")
    reach = longest - k  # a window that holds this place starts or ends at most so many words away
    # A text is cut into blocks of places first, each with the words around them, so what a place carries
    # along does not grow with its text.
    blocks = documents.select(*key, F.size("w").alias("n_words"), F.explode(_blocks(F.col("w"), k, reach)).alias("b"))
    placed = F.transform(
        F.sequence(F.col("b.first"), F.col("b.last")),
        lambda p: F.struct(p.alias("p"), _shingle(F.col("b.words"), p - F.col("b.from"), k).alias("h")),
    )
    places = blocks.select(*key, "n_words", "b.from", "b.words", F.inline(placed))
    places = places.join(F.broadcast(vocabulary) if small(vocabulary) else vocabulary, "h", "left_semi")
    near = F.greatest(F.col("p") - reach, F.lit(0))
    places = stored(
        places.select(
            *key, "p", "h", "n_words", near.alias("from"), F.slice("words", near - F.col("from") + 1, 2 * reach + k).alias("around"),
        ),
        "places",
    )
    # Rarity: how often the corpus holds each shingle; the rarest of a window is its prefix.
    counts = places.groupBy("h").count()
    prefix = (
        of_window.join(counts, "h")
        .groupBy("words", "n")
        .agg(F.count("*").alias("known"), F.min(F.struct("count", "h", "at")).alias("rarest"))
        .where(F.col("known") == F.col("n") - k + 1)  # a window with a shingle the corpus lacks occurs nowhere
        .select("words", "n", F.col("rarest.h").alias("h"), F.col("rarest.at").alias("at"))
        .join(windows.select("words", "items"), "words")
    )
    prefix = stored(prefix, "prefix")
    joined = places.join(F.broadcast(prefix) if small(prefix) else prefix, "h")
    begin = F.col("p") - F.col("at")
    return (
        joined.where((begin >= 0) & (begin + F.col("n") <= F.col("n_words")))
        .where(F.slice("around", begin - F.col("from") + 1, F.col("n")) == F.col("words"))
        .select(*key, begin.alias("start"), "n", "items")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """One row per row of `documents`: its columns, n_words, n_hit, n_items, item_ids, contaminated.

    A word inside an occurrence of any window is hit. Null and empty texts have no words and
    stay clean; equal rows get equal results; an empty benchmark hits nothing; items without
    an id or a word are ignored. Further columns of `documents` are kept, whatever their names;
    the added columns replace columns of the same name.
    """
    added = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    docs = documents.drop(*added).withColumn(
        "_llm_key", F.xxhash64(F.col("text"), F.lit(1))
    ).withColumn("_llm_key2", F.xxhash64(F.lit("text"), F.col("text"), F.lit(2)))
    key = ["_llm_key", "_llm_key2"]
    read = docs.select(*key, words_of(lower_ascii(F.col("text")), BREAKS).alias("w"))
    hits = find_windows(read, benchmark_windows(benchmark, window), key)
    # Word intervals of a text, joined from left to right: the words that each adds to those before it.
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    per_text = hits.groupBy(*key).agg(
        covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids")
    )
    per_text = stored(per_text, "hits")
    counted = docs.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    joined = counted.join(F.broadcast(per_text) if small(per_text) else per_text, key, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        *[F.col(f"`{c}`") for c in documents.columns if c not in added],
        "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"),
        (n_hit > 0).alias("contaminated"),
    )
