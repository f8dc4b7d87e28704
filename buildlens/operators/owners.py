"""Code owners."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.globs import glob_match, glob_to_regex, glob_tokens, token_text, tokens_regex
from buildlens.functions.text import blank_to_null, clean_path
from buildlens.plans.inrow import let
from buildlens.plans.rank import ranked
from buildlens.plans.skew import attach
from buildlens.session import materialize


@dataclass(frozen=True)
class OwnerRule:
    """A pattern and its owners; among matching rules the last one counts."""

    pattern: str
    owners: tuple[str, ...]


def _suffix_match(path: Column, pattern: str) -> Column:
    """Pattern on the whole path or on what follows any of its slashes.

    The last of these candidates is the base name.
    """
    regex = glob_to_regex(pattern)
    if regex is None:
        return F.lit(False)
    body = regex.removeprefix("(?s)^")
    return path.rlike(f"(?s)(?:^|/){body}")


def rule_matches(rooted: Column, pattern: str) -> Column:
    """Whether a rule covers a cleaned path that starts with a slash."""
    if not pattern.startswith("/"):
        return _suffix_match(rooted, pattern)
    test = glob_match(rooted, pattern)
    if pattern.endswith("/"):
        test = test | rooted.startswith(pattern)
    elif pattern.endswith("/*"):
        test = test | rooted.startswith(pattern[:-1])
    return test


def rooted_path(path: Column) -> Column:
    return clean_path(F.concat(F.lit("/"), F.ltrim(path, F.lit("/"))))


def owners_of(rooted: Column, rules: list[OwnerRule]) -> Column:
    """Owners of a rooted path by the last matching rule, or null.

    The rules become one CASE that tries the last rule first and stops at the
    first match. It runs inside the scan of the paths: no join, no shuffle, and
    no pairs of paths and rules.
    """
    result = None
    for rule in reversed(rules):
        owners = F.array(*[F.lit(o) for o in rule.owners])
        test = rule_matches(rooted, rule.pattern)
        result = F.when(test, owners) if result is None else result.when(test, owners)
    return F.lit(None).cast("array<string>") if result is None else result


# Rules up to this number become one expression; more of them are joined as a table.
INLINE_RULES = 50

# Characters that make a pattern more than plain text.
_WILD = r"[*?\[\\]"


def rule_table(rules: DataFrame) -> DataFrame:
    """`rules` (rule_ord, pattern, owners) numbered from 1 as `ord`, each with the `key` of the paths it covers.

    A key is a whole path, a folder and all below it, the end of a path after a slash, or the end
    of a file name from a dot on. Patterns with other wildcards have none.
    """
    pattern, plain = F.col("pattern"), ~F.col("pattern").rlike(_WILD)
    tree = F.regexp_extract("pattern", r"^(/(?:[^*?\[\\]*/)?)\*$", 1)
    ending = F.regexp_extract("pattern", r"^\*(\.[^*?\[\\/]*)$", 1)
    key = (
        F.when(plain & pattern.startswith("/") & pattern.endswith("/"), F.concat(F.lit("folder "), pattern))
        .when(plain & pattern.startswith("/"), F.concat(F.lit("path "), pattern))
        .when(plain, F.concat(F.lit("end "), pattern))
        .when(tree != "", F.concat(F.lit("folder "), tree))
        .when(ending != "", F.concat(F.lit("name "), ending))
    )
    return ranked(rules.select("rule_ord", "pattern", "owners"), [F.asc("rule_ord")], "ord", "rules").select(
        "ord", "pattern", "owners", key.alias("key")
    )


def path_keys(rooted: Column) -> Column:
    """Keys of all plain rules that cover a rooted path."""
    return let(F.split(rooted, "/"), lambda parts: _keys_of_parts(rooted, parts))


def _keys_of_parts(rooted: Column, parts: Column) -> Column:
    def joined(words: Column, kind: str, mark: str, before: str = "") -> Column:
        """The rest of the words from each place on."""
        places = F.filter(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: i <= F.size(words))
        return F.transform(places, lambda i: F.concat(F.lit(f"{kind} {before}"), F.array_join(F.slice(words, i, F.size(words)), mark)))

    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(F.lit("folder "), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")),
    )
    name = F.element_at(parts, -1)
    ends = joined(parts, "end", "/")
    names = let(F.split(name, r"\."), lambda words: joined(words, "name", ".", "."))
    return F.concat(F.array(F.concat(F.lit("path "), rooted)), folders, ends, names)


# Literal text of a glob up to this length is a key as it is; of longer ones a multiple of STEP characters.
EXACT, STEP = 16, 8


def glob_table(rules: DataFrame) -> DataFrame:
    """(place, size, key, regex, best) of the well-formed globs among `rules` (ord, pattern, owners).

    The key is the literal text that a covered path must have at a `place`, `size` characters of it: in
    front of the whole path, behind one of its slashes, or at its end. Of equal patterns the last rule counts.
    """
    last = rules.groupBy("pattern").agg(F.max(F.struct("ord", "owners")).alias("best"))
    tokens = last.withColumn("tokens", glob_tokens(F.col("pattern"))).where("tokens IS NOT NULL")
    texts = F.transform("tokens", token_text)
    wild = F.transform(texts, lambda x: x.isNull())
    split = tokens.withColumns({"texts": texts, "first": F.array_position(wild, True), "last": F.array_position(F.reverse(wild), True)})
    count = F.size("texts")
    lead = F.array_join(F.slice("texts", F.lit(1), F.when(F.col("first") == 0, count).otherwise(F.col("first").cast("int") - 1)), "")
    trail = F.when(F.col("last") == 0, F.lit("")).otherwise(
        F.array_join(F.slice("texts", count - F.col("last").cast("int") + 2, F.col("last").cast("int") - 1), "")
    )
    known = split.withColumns({"lead": lead, "trail": trail})
    by_lead = F.length("lead") >= F.length("trail")
    size = F.greatest(F.length("lead"), F.length("trail"))
    size = F.when(size > EXACT, size - size % STEP).otherwise(size)
    rooted = F.col("pattern").startswith("/")
    place = F.when(~by_lead, F.lit("end")).when(rooted, F.lit("whole")).otherwise(F.lit("part"))
    text = F.when(by_lead, F.expr("left(lead, size)")).otherwise(F.expr("right(trail, size)"))
    start = F.when(rooted, F.lit("(?s)^")).otherwise(F.lit("(?s)(?:^|/)"))
    return (
        known.withColumns({"size": size, "place": place})
        .select(
            "place", "size", F.concat(F.col("place"), F.lit(" "), text).alias("key"),
            F.concat(start, tokens_regex(F.col("tokens")), F.lit("\\z")).alias("regex"), "best",
        )
    )


def _glob_folders(rules: DataFrame) -> DataFrame:
    """Rules of rooted globs that end in a folder; they cover what lies in the folder of just that name, too."""
    pattern = F.col("pattern")
    folder = F.when(pattern.endswith("/"), pattern).when(pattern.endswith("/*"), F.expr("left(pattern, length(pattern) - 1)"))
    found = rules.where(pattern.startswith("/")).withColumn("key", F.concat(F.lit("folder "), folder))
    return found.where("key IS NOT NULL").select("ord", "owners", "key")


def _glob_keys(rooted: Column, shapes: Column) -> Column:
    """The texts of a rooted path at the places and of the sizes that some glob has as its key."""

    def texts(shape: Column) -> Column:
        size = shape["size"]
        parts = F.split(rooted, "/")
        behind = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        inside = F.when(shape["place"] == "part", F.concat(F.array(rooted), behind)).otherwise(F.array(rooted))
        long = F.filter(inside, lambda x: F.length(x) >= size)
        cut = lambda x: F.when(shape["place"] == "end", F.right(x, size)).otherwise(F.left(x, size))
        return F.transform(long, lambda x: F.concat(shape["place"], F.lit(" "), cut(x)))

    return F.array_distinct(F.flatten(F.transform(shapes, texts)))


def _by_globs(distinct: DataFrame, rules: DataFrame) -> DataFrame:
    """(rooted, best) of the globs: each meets only the paths that hold its literal text in place, and is tried on those."""
    globs = materialize(glob_table(rules), "globs")
    # One row: the few pairs of a place and a length.
    shapes = globs.select(F.struct("place", "size").alias("shape")).agg(F.collect_set("shape").alias("shapes"))
    keyed = distinct.crossJoin(F.broadcast(shapes)).select("rooted", F.explode(_glob_keys(F.col("rooted"), F.col("shapes"))).alias("key"))
    met = attach(keyed, globs.select("key", "regex", "best"), ["key"], "inner")
    return met.where(F.expr("rooted RLIKE regex")).select("rooted", "best")


def owners_by_rooted(distinct: DataFrame, rules: DataFrame) -> DataFrame:
    """(rooted, owners) of the distinct rooted paths that some rule of the table covers; the last one counts.

    Plain rules meet a path by the keys they have in common: its folders, its ends, its name; globs
    meet it by their literal text. So a path is compared with as many rules as share a key with it,
    however many rules there are, and none passes through the driver.
    """
    table = materialize(rule_table(rules), "rules")
    paths = materialize(distinct, "rooted")
    keyed = paths.select("rooted", F.explode(path_keys(F.col("rooted"))).alias("key"))
    globs = table.where("key IS NULL AND pattern IS NOT NULL").select("ord", "pattern", "owners")
    plain = table.where("key IS NOT NULL").select("ord", "owners", "key").unionByName(_glob_folders(globs))
    last = plain.groupBy("key").agg(F.max(F.struct("ord", "owners")).alias("best"))
    found = attach(keyed, last, ["key"], "inner").select("rooted", "best")
    if not globs.isEmpty():
        found = found.unionByName(_by_globs(paths, globs))
    return found.groupBy("rooted").agg(F.max("best").alias("best")).select("rooted", F.col("best.owners").alias("owners"))


def _as_table(rules: list[OwnerRule], spark) -> DataFrame:
    rows = [(i, r.pattern, list(r.owners)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord long, pattern string, owners array<string>")


def _with_owners(df: DataFrame, path: Column, rules: list[OwnerRule] | DataFrame, name: str) -> DataFrame:
    """`df` with the owners of a path (null without one) as column `name`."""
    # A column of its own, so the path is cleaned once and not once per rule.
    rooted = df.withColumn("_rooted", rooted_path(path))
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        return rooted.withColumn(name, owners_of(F.col("_rooted"), rules)).drop("_rooted")
    table = rules if isinstance(rules, DataFrame) else _as_table(rules, df.sparkSession)
    distinct = rooted.select(F.col("_rooted").alias("rooted")).where("rooted IS NOT NULL").distinct()
    owned = owners_by_rooted(distinct, table).select(F.col("rooted").alias("_rooted"), F.col("owners").alias(name))
    return attach(rooted, owned, ["_rooted"]).drop("_rooted")


def assign_owners(paths: DataFrame, rules: list[OwnerRule] | DataFrame) -> DataFrame:
    """Add `owners` to rows with a `path`.

    A few rules run inside the scan of the paths; many, or a table of them, are joined.
    """
    return _with_owners(paths, F.col("path"), rules, "owners")


def tag_failures_with_owners(cases: DataFrame, rules: list[OwnerRule] | DataFrame) -> DataFrame:
    """Name the owners in the message of failed cases.

    The path is the file of the case, else its suite.
    """
    path = F.coalesce(blank_to_null(F.col("file")), blank_to_null(F.col("suite")))
    failed = F.col("status") == "fail"
    matched = _with_owners(cases, F.when(failed, path), rules, "_owners").withColumn(
        "_owners", F.array_join(F.when(failed, F.col("_owners")), " ")
    )
    message = blank_to_null(F.col("message"))
    tagged = F.when(
        message.isNotNull(), F.concat(F.lit("["), "_owners", F.lit("] "), message)
    ).otherwise(F.concat(F.lit("[owners: "), "_owners", F.lit("]")))
    return matched.withColumn(
        "message", F.when(F.col("_owners").isNotNull(), tagged).otherwise(F.col("message"))
    ).drop("_owners")
