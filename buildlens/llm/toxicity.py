"""Toxicity from character n-grams scaled by naive Bayes log-count ratios.

A text's character n-grams (code points, A-Z lower-cased) are hashed into 2^`BITS` buckets.
The ratio of a bucket is log((p + a) / (P + a)) - log((q + a) / (Q + a)), where p of P toxic
and q of Q other training texts hold it. Every bucket that LEAST_TEXTS training texts hold is a feature; its
value is its number in the text times its ratio. One more feature, the text's length, stands for
what long texts hold by chance. A logistic regression with an L2 penalty learns the weights.

Training uses at most FIT_LABELS labelled texts, chosen by a hash of doc_id. Spark counts the
buckets over all of them, and the counts reach the driver. The regression reads a sample of
those texts (`fit_rows`, half of each label): their buckets are stored, and each L-BFGS step sums
the gradient over them in Spark block by block, so one vector of 2^`BITS` numbers reaches the
driver in a step, and no texts do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import map_chunks, pieces, smallest, stored
from buildlens.llm.kept import keeping

BITS = 18
SIZES = (5, 6)
SMOOTHING = 1.0
# A feature stands in so many training texts.
LEAST_TEXTS = 5
# Labels used at most; of their texts so many take part in the regression.
FIT_LABELS = 100_000
FIT_ROWS = 8_000
PENALTY = 1e-3
# L-BFGS: steps at most, the steps remembered, the least gain of a step, and tasks of a pass.
STEPS, MEMORY, LEAST_GAIN, PASS_TASKS = 12, 6, 1e-3, 8
# Buckets in a block of a gradient (a bucket table of 2^BITS is cut evenly), and texts looked at together.
BLOCK, TEXTS = 1 << 12, 64
THRESHOLD = 0.7

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_DIGIT = np.uint64(0x100000001B3)


def grams(texts: list, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character n-gram and the text it stands in, repeats included.

    A text is padded with a space on both sides, so word edges at its ends count.
    """
    data = [f" {t or ''} " for t in texts]
    length = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer("".join(data).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    flat = np.where((flat >= 65) & (flat <= 90), flat + np.uint64(32), flat)
    owner = np.repeat(np.arange(len(data), dtype=np.int32), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(flat))
    buckets, owners = [], []
    value = np.zeros(len(flat), np.uint64)
    for n in range(1, max(sizes) + 1):
        # The value of the n characters from each place on, as digits of a number.
        whole = max(len(flat) - n + 1, 0)
        value[:whole] = value[:whole] * _DIGIT + flat[n - 1 :]
        if n in sizes:
            inside = left >= n
            buckets.append((((value[inside] + np.uint64(n)) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int32))
            owners.append(owner[inside])
    return np.concatenate(buckets), np.concatenate(owners)


def held(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) for each bucket that a text holds."""
    bucket, owner = grams(texts)
    seen = np.zeros((len(texts), 1 << BITS), bool)
    seen[owner, bucket] = True
    return np.nonzero(seen)


def lengths(texts: list) -> np.ndarray:
    """The length feature: thousands of characters."""
    return np.fromiter((len(t or "") for t in texts), np.float64, len(texts)) / 1000


@dataclass
class Model:
    weight: np.ndarray  # by bucket: regression weight times ratio
    per_length: float
    bias: float

    def score(self, texts: list) -> np.ndarray:
        """Probability of the toxic class for whole texts; an empty text has no feature."""
        bucket, owner = grams(texts)
        total = np.bincount(owner, self.weight[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + lengths(texts) * self.per_length + self.bias, -30, 30)))


def packed(texts: list, keep: np.ndarray) -> pa.BinaryArray:
    """The n-grams of each text in the buckets that `keep` masks, as bytes: buckets in order, repeats
    included, as the gap to the one before (the first to 0), where a byte 255 goes on with the next one."""
    bucket, owner = grams(texts)
    wanted = keep[bucket]
    both = np.sort((owner[wanted].astype(np.int64) << BITS) | bucket[wanted])
    owner, bucket = both >> BITS, both & ((1 << BITS) - 1)
    gap = bucket.copy()
    gap[1:] -= np.where(owner[1:] == owner[:-1], bucket[:-1], 0)
    used = gap // 255 + 1
    out = np.full(int(used.sum()), 255, np.uint8)
    out[np.cumsum(used) - 1] = gap % 255
    ends = np.r_[0, np.cumsum(np.bincount(owner, used, len(texts)))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def unpacked(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram and the text it stands in."""
    data = np.frombuffer(b"".join(values), np.uint8)
    owner = np.repeat(np.arange(len(values)), np.fromiter(map(len, values), np.int64, len(values)))
    total = np.r_[0, np.cumsum(data, dtype=np.int64)]
    start = np.searchsorted(owner, np.arange(len(values)))
    last = np.flatnonzero(data != 255)
    return total[last + 1] - total[start][owner[last]], owner[last]


def bucket_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of texts of label 1 and 0 by bucket (zero for those in under LEAST_TEXTS), and in all.

    `rows` has text and label.
    """

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(at, TEXTS)
                label = np.array(piece.column(1).to_pylist(), np.int64)
                row, bucket = held(piece.column(0).to_pylist())
                for k in (0, 1):
                    total[k] += np.bincount(bucket[label[row] == k], minlength=1 << BITS)
                texts += np.bincount(label, minlength=2)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[v, w], pa.int32()) for v, w in ((at, -1), (total[1][at], texts[1]), (total[0][at], texts[0]))],
            names=["bucket", "p", "q"],
        )

    parts = rows.select("text", F.col("label").cast("int")).mapInArrow(count, "bucket int, p int, q int")
    sums = stored(parts.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")), "buckets")
    total = sums.where("bucket = -1").first()
    n = np.array([total["p"], total["q"]] if total else [0, 0], float)
    found = sums.where("bucket >= 0").where(F.col("p") + F.col("q") >= LEAST_TEXTS).toArrow()  # 2^BITS rows at most
    p, q = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    at = found["bucket"].to_numpy()
    p[at], q[at] = found["p"].to_numpy(), found["q"].to_numpy()
    return p, q, n


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of labelled rows (doc_id, text, label 0 or 1).

    Without rows of both classes there is no feature, and the score is the share of label 1.
    """
    p, q, n = bucket_counts(rows)
    share = (n[0] + 0.5) / (n.sum() + 1)
    zero = np.zeros(1 << BITS)
    none = Model(zero, 0.0, float(np.log(share / (1 - share))))
    if not n.all():
        return none
    ratio = np.log((p + SMOOTHING) / (n[0] + SMOOTHING)) - np.log((q + SMOOTHING) / (n[1] + SMOOTHING))
    mask = p + q >= LEAST_TEXTS
    if not mask.any():
        return none
    ratio = np.where(mask, ratio, 0.0)
    chosen = stored(rows.select("doc_id", "label").withColumn("h", F.xxhash64(F.lit("fit"), "doc_id")), "fit-labels")
    halves = [smallest(chosen.where(F.col("label") == k), "h", fit_rows // 2) for k in (0, 1)]
    sample = rows.join(F.broadcast(stored(halves[0].unionByName(halves[1]), "fit-rows").select("doc_id").distinct()), "doc_id")

    def active(texts: list) -> dict[str, object]:
        return {"length": lengths(texts), "grams": packed(texts, mask)}

    seen = stored(map_chunks(sample, ["label"], ["text"], active, "length double, grams binary"), "grams")
    of_label = dict(seen.groupBy("label").count().collect())  # two rows
    if len(of_label) < 2:
        return none
    # Both classes weigh alike, whatever their numbers.
    share = np.array([0.5 / of_label[0], 0.5 / of_label[1]])
    w = _least(lambda w: _loss(seen, share, ratio, w), np.zeros((1 << BITS) + 2))
    return Model((w[:-2] * ratio).astype(np.float32), float(w[-2]), float(w[-1]))


def _loss(seen: DataFrame, share: np.ndarray, ratio: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """L2-penalised logistic loss of the weights (buckets, length, bias) over stored rows, and its gradient.

    Tasks cut their sums into blocks, other tasks add the blocks up, and one vector reaches the driver.
    """
    size = len(ratio)
    shared = seen.sparkSession.sparkContext.broadcast(np.r_[w[:size] * ratio, w[size:]].astype(np.float32))

    def blocks(total: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
        parts = [total[low : low + BLOCK].astype(np.float32).tobytes() for low in range(0, size, BLOCK)]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts) + 1), pa.int32()), pa.array([*parts, rest.tobytes()], pa.binary())], names=["block", "part"]
        )

    def over(batches):
        weight, total, rest = shared.value, np.zeros(size), np.zeros(3)
        for batch in batches:
            for piece in pieces(batch, 2):
                label, length = (piece.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                bucket, owner = unpacked(piece.column(2).to_pylist())
                z = np.bincount(owner, weight[bucket], len(label)) + length * weight[size] + weight[size + 1]
                of = share[label]
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * of
                total += np.bincount(bucket, error[owner], size)
                rest += error @ length, error.sum(), (of * (np.logaddexp(0, z) - label * z)).sum()
        yield blocks(total, rest)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(part, np.float64 if len(part) == 24 else np.float32)
                sums[block] = sums.get(block, 0) + values.astype(np.float64)
        small_ = [(b, v.tobytes() if len(v) == 3 else v.astype(np.float32).tobytes()) for b, v in sums.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in small_], pa.int32()), pa.array([v for _, v in small_], pa.binary())], names=["block", "part"]
        )

    schema = "block int, part binary"
    parts = seen.select("label", "length", "grams").coalesce(PASS_TASKS).mapInArrow(over, schema)
    found = dict(parts.repartition(PASS_TASKS, "block").mapInArrow(add, schema).collect())  # one vector
    shared.destroy()
    rest = np.frombuffer(found.pop(len(found) - 1))
    total = np.concatenate([np.frombuffer(found[b], np.float32) for b in range(len(found))]).astype(np.float64)
    gradient = np.r_[total * ratio, rest[:2]]
    gradient[:-1] += PENALTY * w[:-1]
    return rest[2] + PENALTY / 2 * w[:-1] @ w[:-1], gradient


def _least(loss, w: np.ndarray) -> np.ndarray:
    """The point of least loss, by L-BFGS steps from `w`; `loss` gives the value and the gradient."""
    now, gradient = loss(w)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step, parts = gradient.copy(), []
        for s, y in reversed(kept):
            parts.append((s @ step) / (s @ y))
            step -= parts[-1] * y
        step *= (kept[-1][0] @ kept[-1][1]) / (kept[-1][1] @ kept[-1][1]) if kept else 1 / max(1.0, np.linalg.norm(gradient))
        for (s, y), part in zip(kept, reversed(parts)):
            step += (part - (y @ step) / (s @ y)) * s
        size = 1.0
        while not (new := loss(w - size * step))[0] <= now - 1e-4 * size * (gradient @ step):
            size /= 2
            if size < 1e-3:
                return w
        s, y = -size * step, new[1] - gradient
        if s @ y > 1e-12:
            kept = [*kept, (s, y)][-MEMORY:]
        gain = now - new[0]
        w, (now, gradient) = w + s, new
        if gain < LEAST_GAIN:
            break
    return w


def score(documents: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """`columns` of every row and the `score` of its whole text; null scores as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return map_chunks(documents, columns, ["text"], lambda texts: {"score": shared.value.score(texts)}, "score double")


def held_out() -> "F.Column":
    """Whether a row is kept from learning: crc32 of doc_id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, label: str, fit_labels: int = FIT_LABELS) -> DataFrame:
    """(doc_id, text, label) of the rows to learn from.

    At most `fit_labels` labels are used, those with the smallest hashes, so they can be sent to
    every task. A doc_id with both labels teaches neither; of equal texts of one label, whose
    copies would count one opinion many times, the smallest doc_id stays.
    """
    known = (
        labels.where(f"doc_id is not null and {label} in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).alias("_most"))
        .where("label = _most")
        .select("doc_id", "label")
        .where(~held_out())
        .withColumn("h", F.xxhash64(F.lit("label"), "doc_id"))
    )
    known = smallest(stored(known, "all-labels"), "h", fit_labels).drop("h")
    keyed = documents.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"))
    one = keyed.join(F.broadcast(stored(known, "labels")), "doc_id").groupBy("t1", "t2", "label").agg(F.min("doc_id").alias("doc_id"))
    chosen = stored(one.select("doc_id", "label").distinct(), "chosen-labels")
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


@keeping("held_out", "score", "predicted")
def toxicity(
    documents: DataFrame, labels: DataFrame, columns: list[str], threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """`columns` of every row, held_out, score and predicted, by a model of the labelled rows.

    Null and empty texts are scored like any others; a null doc_id teaches nothing and is not held
    out; repeated rows get equal scores. An empty table gives an empty one, and without labels of
    both kinds all scores are the share of label 1. Kept columns may have any name.
    """
    model = fit(labelled(documents, labels, "toxic"), fit_rows)
    scored = score(documents.withColumn("held_out", held_out()), [*columns, "held_out"], model)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
