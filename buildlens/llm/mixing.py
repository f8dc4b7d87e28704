"""Mixing sources to target weights by Pareto order sampling.

A source's target says how many copies of each of its documents are expected. The whole part
of that number is given to every document for certain; for the rest documents are ranked by
random odds over inclusion odds, u / (1 - u) : p / (1 - p), and taken in that order while they
fit into what is left of the target. Sizes are words, so the sample is of a fixed number of
words: a document that does not fit is passed over and the next that fits is taken.

No source is gathered to be ranked. Logarithms of odds ratios are cut into bins; their sums of
words tell the bin in which the target is reached, and only that bin's rows are ordered. The
density of such a logarithm is at most 1/4 whatever the inclusion odds are, so a fine bin holds
at most one in 4 * FINE rows of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm.common import SPACES, stored
from buildlens.llm.kept import Kept, named
from buildlens.plans.rank import ranked
from buildlens.plans.skew import attach

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
# A source is filled when what is missing is at most this part of its target.
TOLERANCE = 0.001
# Bins per unit of the logarithm of odds: first coarse ones, then fine ones in the coarse bin of the cut.
COARSE, FINE = 8, 8192
# Tables with one row for each source are broadcast up to so many sources.
FEW_SOURCES = 50_000
WORD = "[^" + SPACES.replace(" ", "\\x20").replace("\t\n\x0b\x0c\r", "\\x09-\\x0D") + "]+"


def n_words(text: Column) -> Column:
    """Number of runs of characters that are not white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, weight): the weights in turn for the sources in code point order, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = F.array(*[F.lit(float(w)) for w in weights])
    placed = ranked(sources.select("source").distinct(), order, "_place", "llm-sources")
    return placed.select("source", parts[F.pmod(F.col("_place") - 1, F.lit(len(weights))).cast("int")].alias("weight"))


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`sizes` (source_size, weight of each source) with `target`.

    All targets together are `share` times all sizes, in proportion to the weights, but none is
    above `most` times its source's size: what is above goes to the others by their weights,
    until none is above. A round only needs two sums over the sources.
    """
    if share > most:
        raise ValueError("the targets cannot hold that share")
    cap = F.col("source_size") * F.lit(float(most))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = cap < F.col("weight") * F.lit(level)
        row = sizes.agg(
            F.sum(F.when(full, cap)).alias("filled"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        rest, open_ = total * share - (row["filled"] or 0.0), row["open"] or 0.0
        after = rest / open_ if open_ else level
        if after <= level:
            break
        level = after
    even = F.lit(float(rest)) * F.col("weight") / F.lit(float(open_ or 1.0))
    return sizes.withColumn("target", F.when(full, cap).otherwise(F.least(cap, even)))


def mix(
    documents: DataFrame,
    keep: list[str],
    source: str = "source",
    weights: DataFrame | tuple[float, ...] = WEIGHTS,
    importance: str | None = None,
    share: float = SHARE,
    most: float = MOST,
    seed: str = "mix",
    key: str = "doc_id",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """`keep` columns of every row with size, source_size, target and taken, the words the mix takes.

    `weights` are a table (source, weight) or numbers that the sources get in turn. Documents of a
    source are expected in equal numbers of copies, or in proportion to the column `importance`
    (null or negative: 0), never in more than `most`. taken is size times the number of copies,
    which is the expected one rounded up or down. The hash of seed and key is the random number,
    so a run can be repeated.

    Null and empty texts have no words and none are taken; a null source is a source of its own; a
    null key hashes like an empty one. Repeated rows are separate documents and share their random
    number: ties go by key, then by the text's hash, then by place. An empty table gives an empty
    one. Kept columns may have any name; size, source_size, target and taken replace kept ones.
    """
    kept = Kept(keep)
    text_key = F.coalesce(named(key).cast("string"), F.lit(""))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text_key), 256), 1, 13)
    random = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    worth = F.lit(1.0)
    if importance is not None:
        worth = F.greatest(F.coalesce(named(importance).cast("double"), F.lit(0.0)), F.lit(0.0))
    place = F.struct(
        named(key).alias("key"), F.xxhash64("text").alias("text"), F.monotonically_increasing_id().alias("row")
    )
    read = kept.take(
        documents, s=_source_key(named(source)), source=named(source).cast("string"), size=n_words(F.col("text")),
        worth=worth, chance=F.log(random) - F.log1p(-random), tie=place,
    )
    rows = stored(read, "mix-rows")
    sizes = rows.groupBy("s", "source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("worth")).alias("worth_size")
    )
    weighed = _weighed(stored(sizes, "mix-sources"), weights)
    goals = stored(source_targets(weighed, share, most).withColumn("factor", _factor("target", "worth_size")), "mix-goals")
    few = goals.count() <= FEW_SOURCES
    if importance is not None:
        goals = _factors(rows, goals, most, few)
    copies = F.least(F.col("worth") * F.col("factor"), F.lit(float(most)))
    part = copies - F.floor(copies)
    logit = F.when(part > 0, F.col("chance") - F.log(part) + F.log1p(-part))
    planned = _beside(rows, goals, few).withColumn("whole", F.floor(copies)).withColumn("at", F.struct(logit.alias("z"), "tie"))
    planned = stored(planned.drop("tie", "chance", "worth"), "mix-plan")
    drawn = F.exists(
        "rounds",
        lambda r: (F.col("size") <= r["gap"]) & (F.col("at") <= r["last"]) & (r["first"].isNull() | (F.col("at") > r["first"])),
    )
    extra = F.when(F.col("at.z").isNotNull() & F.coalesce(drawn, F.lit(False)), 1).otherwise(0)
    chosen = _beside(planned, _fill(planned, tolerance, few), few)
    chosen = chosen.withColumn("taken", (F.col("size") * (F.col("whole") + extra)).cast("long"))
    return kept.give(chosen, ["size", "source_size", "target", "taken"])


def _source_key(source: Column) -> Column:
    """A key without nulls, since those would not join."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _beside(facts: DataFrame, by_source: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """Facts joined with a table of one row for each source, which is sent whole where sources are few."""
    return facts.join(F.broadcast(by_source), ["s"], how) if few else attach(facts, by_source, ["s"], how)


def _factor(words: str, worth_size: str) -> Column:
    return F.coalesce(F.try_divide(F.col(words), F.col(worth_size).cast("double")), F.lit(0.0))


def _weighed(sizes: DataFrame, weights: DataFrame | tuple[float, ...]) -> DataFrame:
    """`sizes` of the sources with their weights; a source that a table of weights leaves out weighs 0."""
    given = weights if isinstance(weights, DataFrame) else cycled_weights(sizes, weights)
    given = given.select(_source_key(F.col("source")).alias("s"), F.col("weight").cast("double").alias("weight"))
    return stored(sizes.drop("source").join(given, "s", "left").fillna(0.0, ["weight"]), "mix-weights")


def _factors(rows: DataFrame, goals: DataFrame, most: float, few: bool) -> DataFrame:
    """`goals` with the factor at which the copies, none above `most`, meet the target of the source.

    Documents that reach `most` only grow in number, and the factor of the others with them.
    """
    full = 0
    while True:
        whole = F.col("worth") * F.col("factor") >= F.lit(float(most))
        sums = _beside(rows, goals.select("s", "factor"), few).groupBy("s").agg(
            F.sum(F.when(whole, F.col("size") * F.lit(float(most))).otherwise(0.0)).alias("certain"),
            F.sum(F.when(whole, 0.0).otherwise(F.col("size") * F.col("worth"))).alias("open"),
            F.sum(F.when(whole & (F.col("size") > 0), 1).otherwise(0)).alias("full"),
        )
        sums = stored(sums, "mix-factors")
        before, full = full, sums.agg(F.sum("full")).first()[0] or 0
        if full == before:
            return goals
        raised = F.col("target") - F.col("certain")
        factor = F.when(F.col("open") > 0, F.greatest(F.col("factor"), raised / F.col("open"))).otherwise(F.col("factor"))
        goals = stored(goals.join(sums, "s").withColumn("factor", factor).drop("certain", "open", "full"), "mix-goals")


def _fill(planned: DataFrame, tolerance: float, few: bool) -> DataFrame:
    """(s, rounds): in each round documents of at most `gap` words after `first` up to `last` were taken.

    A round takes documents in order up to the first that does not fit any more; the next one goes on
    behind it with those that fit into the smaller gap. Every round has one row for each open source.
    """
    draw = planned.where("at.z IS NOT NULL AND size > 0")
    gap = F.first("target") - F.sum(F.col("size") * F.col("whole"))
    places = draw.select("at").schema["at"].dataType
    start = F.lit(None).cast(places)
    open_ = stored(planned.groupBy("s").agg(gap.alias("gap"), F.first("target").alias("goal")).withColumn("first", start), "mix-open")
    closed = open_.select("s", "gap", "first", F.lit(None).cast(places).alias("last"))
    steps = []
    while True:
        step = stored(_round(draw, open_, few), "mix-round")
        steps.append(step.select("s", "gap", "first", "last"))
        missing = F.col("gap") - F.col("words")
        open_ = step.where(F.col("cut") & (missing > F.lit(tolerance) * F.col("goal"))).select(
            "s", missing.alias("gap"), "goal", F.col("last").alias("first")
        )
        if open_.isEmpty():
            break
    for step in steps:
        closed = closed.unionByName(step)
    return closed.groupBy("s").agg(F.collect_list(F.struct("gap", "first", "last")).alias("rounds"))


def _round(draw: DataFrame, open_: DataFrame, few: bool) -> DataFrame:
    """For each open source that has documents left: last, the words up to there, and whether one did not fit."""
    left = _beside(draw.select("s", "size", "at"), open_, few, "inner").where(
        (F.col("size") <= F.col("gap")) & (F.col("first").isNull() | (F.col("at") > F.col("first")))
    )
    left = left.withColumn("bin", F.floor(F.col("at.z") * COARSE)).withColumn("fine", F.floor(F.col("at.z") * FINE))
    coarse = left.groupBy("s", "bin").agg(F.sum("size").alias("n"), F.first("gap").alias("gap"))
    coarse = coarse.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("bin")))
    over = F.col("upto") > F.col("gap")
    cut = coarse.where(over).groupBy("s").agg(F.min("bin").alias("cut_bin"), F.min(F.col("upto") - F.col("n")).alias("before"))
    inside = _beside(left, cut, few, "inner").where("bin = cut_bin").drop("bin", "cut_bin")
    fine = inside.groupBy("s", "fine").agg(F.sum("size").alias("n"), F.first("gap").alias("gap"), F.first("before").alias("before"))
    fine = fine.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("s").orderBy("fine")))
    fine_cut = fine.where(over).groupBy("s").agg(F.min("fine").alias("cut_fine"), F.min(F.col("upto") - F.col("n")).alias("before"))
    rows = _beside(inside.drop("before"), fine_cut, few, "inner").where("fine = cut_fine")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("at"))
    rows = rows.withColumn("upto", upto.cast("long"))
    no_row = F.lit(None).cast(draw.select("at").schema["at"].dataType["tie"].dataType)
    edge = F.struct((F.first("cut_fine") / F.lit(float(FINE))).alias("z"), no_row.alias("tie"))
    ends = rows.groupBy("s").agg(
        F.coalesce(F.max(F.when(~over, F.col("at"))), edge).alias("last"),
        F.coalesce(F.max(F.when(~over, F.col("upto"))), F.first("before")).alias("words"),
    )
    sums = coarse.groupBy("s").agg(F.max("upto").alias("all_words"))
    beyond = F.struct(F.lit(float("inf")).alias("z"), no_row.alias("tie"))
    return _beside(_beside(open_, sums, few, "inner"), ends, few).select(
        "s", "gap", "goal", "first", F.coalesce("last", beyond).alias("last"),
        F.coalesce("words", "all_words").alias("words"), F.col("last").isNotNull().alias("cut"),
    )
