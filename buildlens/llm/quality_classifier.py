"""Quality score by regularised quadratic discriminant analysis of text statistics.

A whole text is summed up by a few transformed counts. Spark sums the statistics and their
products over all training texts of a class, so each class is one row whatever the corpus.
The covariance of a class is shrunk towards the pooled one and that towards its diagonal,
and factored once (Cholesky). A text's score is the logistic of the difference of the two
log densities (half the difference of squared Mahalanobis distances, with the log
determinants) and the log prior, divided by `temperature`, which keeps their order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from buildlens.llm.common import map_chunks, stored
from buildlens.llm.kept import keeping
from buildlens.llm.toxicity import held_out

TO_POOLED = 0.1
TO_DIAGONAL = 0.05
TEMPERATURE = 4.0
THRESHOLD = 0.5

STATISTICS = (
    "words", "word_length", "symbols", "marks", "digits", "upper", "pipes", "breaks", "line_words",
    "repeated_lines", "distinct_words", "repeated_pairs", "high_bytes", "longest_word", "ends",
)
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_CLASSES = {"symbols": b"#*$%&<>@^~={}[]\\_+/", "marks": b"!?", "pipes": b"|", "ends": b".,;:"}


def statistics(texts: list) -> np.ndarray:
    """One row of transformed statistics per whole text; an empty text's counts are all zero."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        words = data.split()
        n, size = len(words), len(data)
        by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        inside = max(sum(map(len, words)), 1)
        lines = [x for x in data.split(b"\n") if x.strip()]
        pairs = len(set(zip(words, words[1:])))
        share = {k: by_byte[list(v)].sum() / inside for k, v in _CLASSES.items()}
        out[row] = (
            np.log1p(n),
            np.log1p(inside / max(n, 1)),
            _spread(share["symbols"]),
            _spread(share["marks"]),
            _spread(by_byte[list(_DIGITS)].sum() / inside),
            _spread(by_byte[list(_UPPER)].sum() / inside),
            _spread(share["pipes"]),
            _spread(len(lines) / max(n, 1)),
            np.log1p(n / max(len(lines), 1)),
            _spread(1 - len(set(lines)) / max(len(lines), 1)),
            np.log1p(len(set(words))) - np.log1p(n),
            _spread(1 - pairs / max(n - 1, 1) if n > 1 else 0.0),
            _spread(by_byte[128:].sum() / max(size, 1)),
            np.log1p(max(map(len, words), default=0)),
            _spread(share["ends"]),
        )
    return out


def _spread(share: float) -> float:
    """Square root of a share: evens out the variance of small shares."""
    return float(np.sqrt(max(share, 0.0)))


@dataclass
class Class:
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the covariance
    offset: float  # log prior less half the log determinant

    def log_density(self, x: np.ndarray) -> np.ndarray:
        # Forward substitution: the factor is triangular.
        left, z = (x - self.mean).T, np.empty((len(self.mean), len(x)))
        for i, row in enumerate(self.factor):
            z[i] = (left[i] - row[:i] @ z[:i]) / row[i]
        return self.offset - 0.5 * (z**2).sum(axis=0)


@dataclass
class Model:
    good: Class | None
    bad: Class | None
    share: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.good is None or self.bad is None:
            return np.full(len(x), self.share)
        gap = (self.good.log_density(x) - self.bad.log_density(x)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(gap, -30, 30)))


def measured(documents: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of every row and its statistics as an array `x`."""
    return map_chunks(documents, columns, ["text"], lambda texts: {"x": statistics(texts).tolist()}, "x array<double>")


def fit(rows: DataFrame, temperature: float = TEMPERATURE) -> Model:
    """The model of all rows (label 0 or 1, x). A class of fewer than two rows cannot be fitted:
    the score is then the share of label 1 everywhere."""
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(x[i]) for i in range(d)]
    products = [F.sum(x[i] * x[j]) for i in range(d) for j in range(i + 1)]
    found = {}
    for row in rows.groupBy("label").agg(F.count("*"), *sums, *products).collect():  # one row of each class
        total = np.array(row[2 : 2 + d], float)
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = row[2 + d :]
        second += np.tril(second, -1).T
        n = row[1]
        found[row[0]] = (n, total / n, second - np.outer(total, total) / n)
    counts = {k: v[0] for k, v in found.items()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return Model(None, None, share, temperature)
    everything = sum(counts.values())
    pooled = (found[0][2] + found[1][2]) / (everything - 2)
    classes = {}
    for k in (0, 1):
        n, mean, scatter = found[k]
        own = (1 - TO_POOLED) * scatter / (n - 1) + TO_POOLED * pooled
        own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * np.diag(np.diag(pooled))
        factor = np.linalg.cholesky(own + 1e-6 * np.eye(d))
        classes[k] = Class(mean, factor, float(np.log(n / everything) - np.log(np.diag(factor)).sum()))
    return Model(classes[1], classes[0], share, temperature)


@keeping("held_out", "score", "predicted")
def quality(
    documents: DataFrame, labels: DataFrame, columns: list[str], threshold: float = THRESHOLD
) -> DataFrame:
    """`columns` of every row, held_out, score (1: good text) and predicted.

    Null and empty texts are scored from their zero counts. Labels are learnt only from rows
    that are not held out; a doc_id with both labels teaches neither, and equal texts of one
    label count once. A text is read once: its statistics are stored and then joined and scored.
    """
    rows = documents.withColumns(
        {"_doc": F.col("doc_id"), "_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit("text"), "text"), "_held": held_out()}
    )
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("_most"))
        .where("label = _most")
        .drop("_most")
    )
    table = stored(measured(rows, [*columns, "_doc", "_t1", "_t2", "_held"]), "statistics")
    taught = table.where("NOT _held").select("_doc", "_t1", "_t2", "x").join(known, "_doc")
    model = fit(taught.dropDuplicates(["_t1", "_t2", "label"]).select("label", "x"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = table.select(*[F.col(f"`{c}`") for c in columns], F.col("_held").alias("held_out"), "x")
    target = StructType([*kept.drop("x").schema.fields, *StructType.fromDDL("score double").fields])
    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).flatten()).reshape(-1, len(STATISTICS))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.score(x))], schema=arrow)

    scored = kept.mapInArrow(run, target)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
