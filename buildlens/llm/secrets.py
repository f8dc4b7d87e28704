"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are long runs of the characters that keys and tokens are made of, with the text
around them. The forest judges each by its length, character classes and their transitions,
the share of it that the corpus's own vocabulary covers, its path, and the neighbouring words.
It is trained from labelled findings; `seed_labels` labels the clear ones of a corpus that has
none: keys of a known issuer and random strings assigned to a name of a secret, against strings
made of ordinary words, plain numbers and placeholders.

Everything is DataFrame operations and Spark's own forest; a text is read twice, once for the
vocabulary and once for the candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm.common import smallest, stored
from buildlens.llm.kept import keeping
from buildlens.plans.inrow import let

LEAST_LENGTH = 16
BEFORE, AFTER = 60, 30
DICTIONARY_WORDS = 4096
FIT_FINDINGS = 20_000
TREES, DEPTH, SEED = 40, 7, 42
THRESHOLD = 0.5

_CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}={{0,2}}"
# Names that secrets are assigned to, key formats of issuers, placeholder words.
_SECRET_NAME = r"(?i)(pass(word|wd)?|pwd|secret|token|api_?key|auth|credential|private_?key)"
_ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,})$"
_PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|xxxx|1234567890)"
_TEST_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "runs_per_char", "distinct_share", "hex", "coverage",
    "slashes", "test_path", "name_before", "names_near", "assigned", "quoted", "placeholder", "before_length",
    "after_letter", "issued",
)


def candidates(documents: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """One row per candidate: `columns`, number, start, end (code points), secret, before, after, path.

    Null, empty and clean texts give no row. A candidate's number is its place in its text.
    """
    keep = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    found = documents.select(
        *keep,
        (F.col(f"`{path}`").cast("string") if path else F.lit(None).cast("string")).alias("path"),
        "text", F.regexp_extract_all("text", F.lit(_CANDIDATE), F.lit(0)).alias("hits"),
    ).where("size(hits) > 0")
    # Each candidate takes its own surroundings along and not the pieces of the whole text.
    def beside(parts: Column) -> Column:
        return F.transform(
            "hits",
            lambda hit, i: F.struct(
                i.alias("number"), hit.alias("secret"), F.char_length(F.get(parts, i)).alias("skip"),
                F.right(F.get(parts, i), F.lit(BEFORE)).alias("before"), F.left(F.get(parts, i + 1), F.lit(AFTER)).alias("after"),
            ),
        )

    rows = found.select(
        *[f"c{i}" for i in range(len(columns))], "path",
        F.xxhash64("text", *[f"c{i}" for i in range(len(columns))]).alias("row"), let(F.split("text", _CANDIDATE), beside).alias("found"),
    ).select(*[f"c{i}" for i in range(len(columns))], "path", "row", F.inline("found"))
    so_far = Window.partitionBy("row").orderBy("number").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Equal rows have equal numbers; each number counts once.
    copies = F.count("*").over(Window.partitionBy("row", "number"))
    ends = F.sum((F.col("skip") + F.char_length("secret")) / copies).over(so_far)
    placed = rows.withColumn("end", F.round(ends).cast("int"))
    return placed.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "number",
        (F.col("end") - F.char_length("secret")).alias("start"), "end", "secret", "before", "after", "path",
    )


def dictionary(documents: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """Three-letter pieces of the most frequent words of the whole corpus, at least four letters long.

    The list comes from `words` rows, whatever the corpus."""
    counted = (
        documents.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word"))
        .where("length(word) >= 4").groupBy("word").count()
    )
    top = counted.orderBy(F.desc("count"), "word").limit(words)
    pieces = top.select(F.explode(_pieces(F.col("word"))).alias("piece")).distinct()
    return sorted(r[0] for r in pieces.collect())  # at most the pieces of `words` words


def _pieces(word: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(word) - 2, F.lit(1))), lambda i: F.substr(word, i, F.lit(3))
    )


def _share(text: Column, pattern: str) -> Column:
    return 1.0 - F.char_length(F.regexp_replace(text, pattern, "")) / F.char_length(text)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def with_features(found: DataFrame, known: list[str]) -> DataFrame:
    """The candidates with the columns FEATURES; `known` is the dictionary."""
    s, before, after = F.col("secret"), F.col("before"), F.col("after")
    runs = s
    for pattern, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
        runs = F.regexp_replace(runs, pattern, mark)
    letters = F.regexp_replace(F.lower(s), "[^a-z]+", "")
    pieces = _pieces(letters)
    inside = F.size(F.filter(pieces, lambda p: p.isin(known))) if known else F.lit(0)
    last_word = F.regexp_extract(before, r"(\w+)\W*$", 1)
    values = {
        "length": F.char_length(s).cast("double"),
        "digit_share": _share(s, "[0-9]"),
        "upper_share": _share(s, "[A-Z]"),
        "lower_share": _share(s, "[a-z]"),
        "runs_per_char": F.char_length(runs) / F.char_length(s),
        "distinct_share": F.size(F.array_distinct(F.split(s, ""))) / F.char_length(s),
        "hex": _flag(s.rlike("^[0-9a-fA-F]+$")),
        "coverage": F.when(F.char_length(letters) >= 3, inside / F.size(pieces)).otherwise(F.lit(0.0)),
        "slashes": F.char_length(F.regexp_replace(s, "[^/]", "")).cast("double"),
        "test_path": _flag(F.col("path").rlike(_TEST_PATH)),
        "name_before": _flag(last_word.rlike(_SECRET_NAME)),
        "names_near": F.regexp_count(before, F.lit(_SECRET_NAME)).cast("double"),
        "assigned": _flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": _flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        "placeholder": _flag(F.concat(before, s).rlike(_PLACEHOLDER)),
        "before_length": F.char_length(last_word).cast("double"),
        "after_letter": _flag(after.rlike(r"^\p{L}")),
        "issued": _flag(s.rlike(_ISSUED)),
    }
    return found.withColumns({name: F.coalesce(values[name], F.lit(0.0)) for name in FEATURES})


def seed_labels(described: DataFrame) -> DataFrame:
    """The candidates whose label is clear, with `label` 1 (secret) or 0."""
    c = F.col
    random = (c("digit_share") > 0.1) & (c("coverage") < 0.5)
    secret = (c("issued") == 1) | ((c("name_before") == 1) & (c("assigned") == 1) & random & (c("placeholder") == 0))
    plain = (c("placeholder") == 1) | (c("digit_share") == 1) | ((c("digit_share") == 0) & (c("coverage") > 0.6))
    label = F.when(secret, F.lit(1.0)).when(plain & (c("name_before") == 0), F.lit(0.0))
    return described.withColumn("label", label).where("label is not null")


def _vectors(described: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described)


def train(findings: DataFrame, fit_findings: int = FIT_FINDINGS) -> RandomForestClassificationModel | None:
    """The forest of labelled findings (FEATURES and label); None unless both labels occur.

    At most `fit_findings` rows of each label are used, those with the smallest hashes; both
    labels weigh the same in all.
    """
    hashed = findings.select(*FEATURES, "label", F.xxhash64("secret", "before", "after").alias("h"))
    parts = [smallest(stored(hashed.where(F.col("label") == y), "labelled"), "h", fit_findings) for y in (0.0, 1.0)]
    sample = stored(parts[0].unionByName(parts[1]), "findings")
    counts = dict(sample.groupBy("label").count().collect())  # two rows
    if len(counts) < 2:
        return None
    weight = F.when(F.col("label") == 1, F.lit(0.5 / counts[1.0])).otherwise(F.lit(0.5 / counts[0.0]))
    ready = _vectors(sample.withColumn("weight", weight * sum(counts.values()))).coalesce(1).sortWithinPartitions("h", *FEATURES)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", featureSubsetStrategy="sqrt", minInstancesPerNode=2
    )
    return forest.fit(ready)


@keeping("number", "start", "end", "secret", "before", "after", "path", *FEATURES, "score", "is_secret")
def scan(
    documents: DataFrame, columns: list[str], path_column: str | None = None, findings: DataFrame | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every candidate with its score (0 to 1) and `is_secret`; `path_column` names the column with a text's path.

    `findings` are labelled rows of `with_features`; without them the corpus's seed labels serve.
    Without both labels nothing can be told apart and only keys of known issuers are secrets. Null
    and empty texts and empty tables have no candidates. Kept columns may have any name.
    """
    described = stored(with_features(candidates(documents, columns, path_column), dictionary(documents)), "candidates")
    model = train(seed_labels(described) if findings is None else findings)
    if model is None:
        return described.withColumn("score", F.col("issued")).withColumn("is_secret", F.col("issued") == 1)
    scored = model.transform(_vectors(described))
    score = vector_to_array("probability")[1]
    return scored.withColumn("score", score).withColumn("is_secret", F.col("score") >= threshold).drop(
        "features", "rawPrediction", "probability", "prediction"
    )
