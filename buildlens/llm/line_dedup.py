"""Near-duplicate lines by an exact set-similarity join; the later line of a match goes.

A line's tokens are its distinct shingles of `shingle` words (a shorter line is one token).
Lines match if the Jaccard similarity of their token sets is at least `percent` / 100. A line
goes if an earlier line matches it, judged on the input.

Lines of equal sets are one class from the start, so repeated lines cost one row each. Then:

1. Prefix filter in hash order. Two matching sets of n tokens share one of their first
   p = n - ceil(t n) + 1, and k of their first p + k - 1. The tokens of such prefixes are counted
   (folded to few bits: a chance hit only lets a class pass); classes with fewer than k tokens
   that occur elsewhere are done. That is nearly all text.
2. Rarity. The tokens of the classes that are left are counted, and each class is ordered anew,
   frequent tokens last; its first p tokens are what it is joined by.
3. Join. Classes that share a prefix token are compared under the length and positional
   bounds, and their Jaccard similarity is verified on whole sets. A class needs one earlier match
   only, so it meets the earliest few classes of each token first, which a window hands to every
   row of the token; only those still without a match meet the next, larger block by a join.
   Groups of thousands of variants end after the first blocks, and a token that thousands of unlike
   lines share is worked off without ever emitting the pairs of lines that already went.

Everything is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm.common import SPACES, small, stored
from buildlens.llm.kept import keeping
from buildlens.plans.inrow import let

SHINGLE_WORDS = 5
PERCENT = 80
# Earlier classes that a class meets in the first round, and the growth of that number.
FIRST_BLOCK, GROWTH = 4, 8
# Tokens of more classes than this are frequent: their number decides their place in the order.
FREQUENT = 8
# Prefix tokens are folded to 32 bits for counting while the input is smaller than this, else to 64.
FOLD_BYTES = 64 << 30
# Keys and tokens are broadcast while their stored tables are smaller than this.
KEY_BYTES = 24 << 20
LAST = (1 << 63) - 1
# White space inside a line, and what a text holds where it is not one plain space each.
_SPACE = r"[\x20\x09\x0B-\x0D]+"
_ODD_SPACES = ("\t", "\x0b", "\x0c", "\r", "  ")


def _known(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, KEY_BYTES) else df


def _shingle_hashes(words: Column, size: int) -> Column:
    """Hash of every run of `size` words, from the hashes of its words; a shorter line gives one."""

    def runs(hashes: Column) -> Column:
        starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, size)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _tokens(lines: DataFrame, shingle: int) -> DataFrame:
    """`lines` with the sorted distinct token hashes of `line`."""
    words = F.split(F.btrim("line"), " ")
    return lines.withColumn("tokens", F.sort_array(F.array_distinct(_shingle_hashes(words, shingle)))).drop("line")


def _prefix_size(n, percent: int):
    """Tokens of a set of n that must share one with a matching set; fewer than 1/(1 - t) tokens match equal sets only."""
    need = F.ceil(n * percent / 100)
    return F.when(n * (100 - percent) >= percent, n - need + 1).otherwise(F.lit(0)).cast("int")


def _needed(n, percent: int):
    """k of the first filter: about half of a prefix."""
    return F.ceil(_prefix_size(n, percent) / 2).cast("int")


def _spaced(text: Column) -> Column:
    """The text with one plain space for all white space between two words of a line; most texts have that."""
    odd = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in _ODD_SPACES])
    return F.when(odd, F.regexp_replace(text, _SPACE, " ")).otherwise(text)


def _lines(documents: DataFrame) -> DataFrame:
    """Every line with a word: its place (doc, t1, no) in the corpus order, and its text with plain spaces."""
    lines = F.split(_spaced(F.coalesce("text", F.lit(""))), "\n")
    return documents.select("doc", "t1", F.posexplode(lines).alias("no", "line")).where(F.btrim("line") != "")


def _written(text: Column) -> Column:
    """Number of lines with a word."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))


def _placed(documents: DataFrame) -> DataFrame:
    return documents.withColumns(
        {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "t1": F.xxhash64("text")}
    )


def _folded(tokens):
    return F.transform(tokens, lambda t: F.shiftrightunsigned(t, 33).cast("int"))


_PLACE = ("doc", "t1", "no")


def repeated_lines(documents: DataFrame, shingle: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc, t1, no): the lines (numbered from 0) that an earlier line matches.

    doc is doc_id, or the largest long where it is null; t1 is a hash of the text. Lines are
    ordered by doc, t1 and number; equal rows have equal places and never remove each other's lines.
    """
    texts = _placed(documents).select("doc", "t1", "text")
    narrow = small(documents, FOLD_BYTES)
    n, parsed = F.size("tokens"), _tokens(_lines(texts), shingle)
    long_prefix = F.slice("tokens", 1, F.greatest(_prefix_size(n, percent) + _needed(n, percent) - 1, F.lit(0)))
    lines = stored(
        parsed.select(
            *_PLACE, F.xxhash64("tokens").alias("s1"), F.xxhash64(F.lit("set"), "tokens").alias("s2"),
            _needed(n, percent).alias("k"), (_folded(long_prefix) if narrow else long_prefix).alias("prefix"),
        ),
        "lines",
    )
    # Classes of several places; every other line is the only one of its class.
    again = stored(lines.groupBy("s1", "s2").count().where("count > 1").select("s1", "s2"), "repeated-classes")
    several = stored(
        lines.select(*_PLACE, "s1", "s2").join(_known(again), ["s1", "s2"])
        .groupBy("s1", "s2").agg(F.min(F.struct(*_PLACE)).alias("first")), "classes",
    )
    firsts = lines.where("k > 0").join(_known(several), ["s1", "s2"], "left").where(
        F.col("first").isNull() | (F.col("first") == F.struct(*_PLACE))
    ).select(*_PLACE, "k", "prefix")
    near = _near_classes(texts, firsts, shingle, percent)

    later = lines.select(*_PLACE, "s1", "s2").join(_known(several), ["s1", "s2"], "left").join(
        _known(near).withColumn("near", F.lit(True)), ["s1", "s2"], "left"
    )
    return later.where(F.col("near") | (F.struct(*_PLACE) > F.col("first"))).select(*_PLACE).distinct()


def _near_classes(texts: DataFrame, firsts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(s1, s2) of the classes that match a class with an earlier first line."""
    # 1. Classes with enough prefix tokens that other classes have too.
    posted = firsts.select(*_PLACE, "k", F.explode("prefix").alias("token"))
    met = stored(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "met")
    meeting = stored(
        posted.join(_known(met), "token", "left_semi").groupBy(*_PLACE, "k").agg(F.count("*").alias("n"))
        .where("n >= k").select(*_PLACE), "meeting",
    )

    # 2. Their whole sets, and the frequent ones of their tokens.
    if small(meeting, KEY_BYTES):  # texts without such a line are not taken apart again
        texts = texts.join(F.broadcast(meeting.select("doc", "t1").distinct()), ["doc", "t1"], "left_semi")
    wanted = _tokens(_lines(texts).join(_known(meeting), list(_PLACE), "left_semi"), shingle)
    sets = stored(
        wanted.select(
            F.xxhash64("tokens").alias("s1"), F.xxhash64(F.lit("set"), "tokens").alias("s2"),
            *_PLACE, F.size("tokens").alias("n"), "tokens",
        ),
        "sets",
    )
    tokens = sets.select("s1", "s2", F.explode("tokens").alias("token"))
    frequent = stored(tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > FREQUENT), "frequent")
    often = stored(
        tokens.join(_known(frequent), "token").groupBy("s1", "s2").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("often")), "often",
    )
    late = F.transform("often", lambda o: o["token"])
    order = F.when(F.col("often").isNull(), F.col("tokens")).otherwise(F.concat(F.array_except("tokens", late), late))
    posts = sets.join(_known(often), ["s1", "s2"], "left").select(
        "s1", "s2", *_PLACE, "n", F.posexplode(F.slice(order, 1, _prefix_size(F.col("n"), percent))).alias("at", "token")
    )

    # 3. Blocks of earlier classes, until every class has a match or met all before it.
    ranked = stored(_ranked(posts, percent), "ranked")
    pairs = ranked.select("s1", "s2", F.explode("early").alias("e")).where("e IS NOT NULL").select("s1", "s2", "e.e1", "e.e2")
    near = found = _verified(pairs, sets, percent)
    # A row that the table holds twice gives its class twice; here it stays once, whatever its rank.
    later = stored(
        ranked.where("more IS NOT NULL").select("s1", "s2", "more.*").dropDuplicates(["token", "s1", "s2"]), "later"
    )
    done, block = FIRST_BLOCK, FIRST_BLOCK * GROWTH
    while True:
        open_ = stored(later.where(F.col("size") > done).join(_known(near), ["s1", "s2"], "left_anti"), "open")
        if open_.isEmpty():
            return near
        top = done + block
        earlier = stored(
            later.where((F.col("rank") <= top) & (F.col("rank") > done))
            .select("token", F.col("s1").alias("e1"), F.col("s2").alias("e2"), F.col("n").alias("m"),
                    F.col("at").alias("e_at"), F.col("first").alias("e_first")), "earlier",
        )
        met_now = _known(open_).join(earlier, "token") if small(open_, KEY_BYTES) else open_.join(_known(earlier), "token")
        bounds = _may_match(*[F.col(c) for c in ("first", "n", "at", "e_first", "m", "e_at")], percent)
        found = _verified(met_now.where(bounds).select("s1", "s2", "e1", "e2"), sets, percent)
        near = stored(near.unionByName(found), "near")
        done, block = top, block * GROWTH


def _may_match(first, n, at, e_first, m, e_at, percent: int) -> Column:
    """Whether a set of n tokens can match an earlier one of m that shares the token at `at` and `e_at` of their orders."""
    need = F.ceil((n + m) * percent / (100 + percent))
    return (
        (e_first < first) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - at, m - e_at) >= need)
    )


def _ranked(posts: DataFrame, percent: int) -> DataFrame:
    """Rows of tokens that several classes hold: `early`, those of the token's first FIRST_BLOCK rows
    that the class can match (else null), and in `more` its place among the rows where there are more of them.
    """
    by_place = Window.partitionBy("token").orderBy(*_PLACE, "s1", "s2")
    whole = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.struct(*_PLACE).alias("first")
    item = F.struct(F.col("s1").alias("e1"), F.col("s2").alias("e2"), first, "n", "at")
    places = [f"e{i}" for i in range(1, FIRST_BLOCK + 1)]
    # Rows of a token alone are left out before the others get the first rows of theirs.
    sized = posts.withColumns({"rank": F.row_number().over(by_place), "size": F.count("*").over(whole)}).where("size > 1")
    placed = sized.withColumns({e: F.nth_value(item, i).over(whole) for i, e in enumerate(places, 1)})

    def early(e: Column) -> Column:
        bounds = _may_match(first, F.col("n"), F.col("at"), e["first"], e["n"], e["at"], percent)
        return F.when(bounds, F.struct(e["e1"].alias("e1"), e["e2"].alias("e2")))

    more = F.when(F.col("size") > FIRST_BLOCK, F.struct("token", first, "n", "at", "rank", "size"))
    found = placed.select("s1", "s2", *[early(F.col(e)).alias(e) for e in places], more.alias("more"))
    return found.where(F.coalesce(*places).isNotNull() | F.col("more").isNotNull()).select(
        "s1", "s2", F.array(*places).alias("early"), "more"
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(s1, s2) of the pairs of classes (s1, s2) and (e1, e2) that match."""
    pairs = stored(pairs.distinct(), "pairs")
    left = stored(sets.select("s1", "s2", F.col("tokens").alias("a")).join(_known(pairs), ["s1", "s2"]), "left-sets")
    right = sets.select(F.col("s1").alias("e1"), F.col("s2").alias("e2"), F.col("tokens").alias("b"))
    right = right.join(_known(pairs.select("e1", "e2")), ["e1", "e2"], "left_semi")
    same = F.size(F.array_intersect("a", "b"))
    found = right.join(_known(left), ["e1", "e2"]).where(same * 100 >= (F.size("a") + F.size("b") - same) * percent)
    return stored(found.select("s1", "s2").distinct(), "found")


@keeping("n_lines", "removed")
def deduplicate(
    documents: DataFrame, columns: list[str], shingle: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """`columns` of every row with n_lines (lines with a word) and `removed`, the sorted numbers of its
    lines that an earlier line matches.

    Null and empty texts have no lines, and an empty table gives an empty one. Only `doc_id`, `text`
    and the named columns are read; these may have any name.
    """
    rows = _placed(documents).select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], "doc", "t1",
        _written(F.col("text")).cast("long").alias("n_lines"),
    )
    gone = repeated_lines(documents, shingle, percent)
    lists = stored(gone.groupBy("doc", "t1").agg(F.sort_array(F.collect_list("no")).alias("removed")), "removed")
    joined = rows.join(_known(lists), ["doc", "t1"], "left")
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "n_lines",
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def without_lines(text, removed):
    """SQL column: the text without the lines of those numbers; the other lines are unchanged."""
    lines = F.split(text, "\n")
    return F.when(F.size(removed) == 0, text).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(removed, i)), "\n")
    )
