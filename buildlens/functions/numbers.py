"""Number expressions: percentages, parsing, fixed-point and delta texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NANOS_PER_SECOND = 1_000_000_000
NANOS_PER_MILLI = 1_000_000


def pct(covered: Column, total: Column) -> Column:
    """covered / total as a percentage; 0 when there is nothing to cover."""
    return F.when(total == 0, F.lit(0.0)).otherwise(
        covered.cast("double") / total.cast("double") * F.lit(100.0)
    )


def round2(x: Column) -> Column:
    """Two places, halves away from zero."""
    return F.round(x * F.lit(100.0)) / F.lit(100.0)


def parse_int(c: Column) -> Column:
    """Strict decimal integer; null for anything else."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))


def parse_int_or_zero(c: Column) -> Column:
    return F.coalesce(parse_int(c), F.lit(0).cast("bigint"))


def parse_float(c: Column) -> Column:
    """Decimal floating-point text; null for anything else."""
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


# Numbers of a range that one row lists at once.
RANGE_PIECE = 1 << 16


def numbers_between(df: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """A row for each whole number from `first` to `last`; none where the range is empty.

    A long range is cut into pieces first, so no row holds more than a piece of it.
    """
    piece, begin = F.lit(RANGE_PIECE).cast("bigint"), F.col(first).cast("bigint")
    pieces = F.call_function("div", F.col(last).cast("bigint") - begin, piece)
    cut = df.where(F.col(first) <= F.col(last)).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces)).alias("_piece"))
    low = begin + F.col("_piece") * piece
    high = F.least(low + piece - 1, F.col(last).cast("bigint"))
    return cut.select("*", F.explode(F.sequence(low, high)).alias(name)).drop("_piece")


def seconds_to_nanos(seconds: Column) -> Column:
    """Whole nanoseconds; absent and absurd values are 0."""
    nanos = (seconds * F.lit(float(NANOS_PER_SECOND))).try_cast("bigint")
    return F.coalesce(nanos, F.lit(0).cast("bigint"))


def secs_to_ns(c: Column) -> Column:
    """Seconds as text to nanoseconds; invalid or non-positive text is 0."""
    seconds = parse_float(c)
    return F.when(seconds > 0, seconds_to_nanos(seconds)).otherwise(F.lit(0).cast("bigint"))


def nanos_to_millis(ns: Column) -> Column:
    """Whole milliseconds, truncated towards zero."""
    return F.call_function("div", ns, F.lit(NANOS_PER_MILLI))


def _scaled(x: Column, digits: int) -> tuple[Column, Column]:
    """x * 10**digits as an exact pair (sum, rounding error)."""

    def two_sum(a: Column, b: Column) -> tuple[Column, Column]:
        s = a + b
        shadow = s - a
        return s, (a - (s - shadow)) + (b - shadow)

    if digits == 1:
        return two_sum(x * 8.0, x * 2.0)
    if digits == 2:
        high, high_err = two_sum(x * 64.0, x * 32.0)
        total, low_err = two_sum(high, x * 4.0)
        return total, high_err + low_err
    raise ValueError("one or two digits")


def fixed(x: Column, digits: int = 1, ties: str = "even") -> Column:
    """Fixed-point text rounded from the exact binary value of `x`.

    Java's formatter rounds the shortest decimal text instead, which differs on
    ties such as 26.25. `ties` is "even" for reports and "up" for page views.
    """
    total, err = _scaled(F.abs(x), digits)
    whole = F.floor(total)
    above_half = total - whole.cast("double") - 0.5
    tie_up = F.lit(True) if ties == "up" else (whole % 2 == 1)
    up = (above_half > 0) | ((above_half == 0) & ((err > 0) | ((err == 0) & tie_up)))
    units = whole + F.when(up, 1).otherwise(0)
    base = 10**digits
    return F.concat(
        F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(units / base).cast("string"),
        F.lit("."),
        F.lpad((units % base).cast("string"), digits, "0"),
    )


def pct_text(x: Column) -> Column:
    return F.concat(fixed(x), F.lit("%"))


def fmt_pct_delta(d: Column) -> Column:
    """`+2.3%`, `-1.1%` or `0.0%`."""
    return F.concat(F.when(d > 0, F.lit("+")).otherwise(F.lit("")), pct_text(d))


def fmt_int_delta(d: Column) -> Column:
    """`+3`, `-2` or `0`."""
    return F.concat(F.when(d > 0, F.lit("+")).otherwise(F.lit("")), d.cast("string"))


def delta_colour(d: Column, bad: Column | None = None) -> Column:
    """Colour of a signed number in a comparison: red, green or none.

    Counts pass their own `bad` rule; percentages are bad when they fall.
    """
    is_bad = (d < 0) if bad is None else bad
    return F.when(d == 0, F.lit("none")).when(is_bad, F.lit("red")).when(d > 0, F.lit("green")).otherwise(
        F.lit("none")
    )


def fmt_duration_ms(ms: Column) -> Column:
    """Case duration: `< 1ms`, `Nms` or `N.NNs`."""
    return (
        F.when(ms < 1, F.lit("< 1ms"))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .otherwise(F.concat(fixed(ms.cast("double") / 1000.0, 2, ties="up"), F.lit("s")))
    )


def fmt_run_duration(ns: Column) -> Column:
    """Run duration: a dash when unknown, `Ns` or `Nm Ns`."""
    secs = F.call_function("div", ns, F.lit(NANOS_PER_SECOND))
    return (
        F.when(ns == 0, F.lit("–"))
        .when(secs < 60, F.concat(secs.cast("string"), F.lit("s")))
        .otherwise(
            F.concat(F.floor(secs / 60).cast("string"), F.lit("m "), (secs % 60).cast("string"), F.lit("s"))
        )
    )


# The bounds of the coverage bands, in percent.
GOOD_PCT = 80.0
WARN_PCT = 50.0


def coverage_band(p: Column) -> Column:
    """none / fail / warn / pass badge of a file."""
    return (
        F.when(p == 0, F.lit("none"))
        .when(p < WARN_PCT, F.lit("fail"))
        .when(p < GOOD_PCT, F.lit("warn"))
        .otherwise(F.lit("pass"))
    )


def traffic_light(p: Column, good, warn, poor) -> Column:
    """One of three values by the 80 % and 50 % bounds."""
    return F.when(p >= GOOD_PCT, F.lit(good)).when(p >= WARN_PCT, F.lit(warn)).otherwise(F.lit(poor))


def coverage_emoji(p: Column) -> Column:
    return traffic_light(p, "🟢", "🟡", "🔴")


def band_colour(p: Column) -> Column:
    """Bar colour of a file or directory."""
    return traffic_light(p, "#22c55e", "#f59e0b", "#ef4444")


def treemap_colour(p: Column) -> Column:
    """Five-step colour of a treemap cell."""
    # Lower bound and colour of each step.
    steps = [(80, "#22c55e"), (60, "#84cc16"), (40, "#f59e0b"), (20, "#ef4444")]
    colour = F.lit("#991b1b")
    for bound, value in reversed(steps):
        colour = F.when(p >= bound, F.lit(value)).otherwise(colour)
    return colour
