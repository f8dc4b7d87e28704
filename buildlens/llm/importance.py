"""Importance resampling towards a target text, with bit-sliced exact weights.

Word runs are hashed into buckets. A bucket's gain is the logarithm of its share in the target
over its share in the corpus, as an integer, and a document's weight the sum of its features'
gains. The sum is taken bit by bit: plane j of a document has the buckets whose count has bit j,
gain plane k those whose gain (two's complement) has bit k, and

    weight = sum over j, k of 2^(j + k) * popcount(plane j AND gain plane k)

with the topmost gain plane counted negative. Documents are drawn by weight plus Gumbel noise.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from buildlens.llm.common import map_chunks, stored
from buildlens.llm.kept import Kept, named
from buildlens.plans.rank import ranked

BUCKETS = 10_000
RUN = 1
LEAST_WORDS = 20
SHARE = Fraction(10, 100)
SEED = "2024"
SCALE = 1000
# Letters and digits of ASCII and every other byte of UTF-8; upper case is lowered before.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# A task remembers the buckets of so many different words.
REMEMBERED = 200_000
# So many plane words are counted at once (8 bytes each).
BLOCK = 1 << 20

_BUCKET_OF: dict[int, dict[bytes, int]] = {}


def _buckets(features: list[bytes], buckets: int) -> list[int]:
    known = _BUCKET_OF.setdefault(buckets, {})
    if len(known) > REMEMBERED:
        known.clear()
    for f in set(features).difference(known):
        known[f] = zlib.crc32(f) % buckets
    return list(map(known.__getitem__, features))


def features(text: str, run: int = RUN) -> tuple[list[bytes], int]:
    """(all runs of 1 to `run` words, number of words)"""
    words = WORD.findall(text.encode("utf-8").lower())
    out = list(words)
    for n in range(2, run + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out, len(words)


def counted(documents: DataFrame, keep: list[str], run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """`keep` columns of every row with n_words, n_features, and its buckets and their counts as arrays."""

    def over(texts: list) -> dict[str, object]:
        n_words, n_features, all_buckets, places = [], [], [], []
        for i, text in enumerate(texts):
            found, n = features(text or "", run)
            n_words.append(n)
            n_features.append(len(found))
            all_buckets += _buckets(found, buckets)
        row = np.repeat(np.arange(len(texts)), n_features)
        key, n = np.unique(row * buckets + np.array(all_buckets, np.int64), return_counts=True)
        places = np.searchsorted(key, np.arange(len(texts) + 1) * buckets).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(places), pa.array(v)) for v in ((key % buckets).astype(np.int32), n)]
        return {"n_words": n_words, "n_features": n_features, "bucket": lists[0], "n": lists[1]}

    return map_chunks(documents, keep, ["text"], over, "n_words long, n_features long, bucket array<int>, n array<long>")


def totals(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket: each task adds its rows up first, `buckets` numbers reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2)]
            np.add.at(total, at, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = table.select("bucket", "n").mapInArrow(sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln(share in the target / share in the corpus)) with one feature added to each bucket."""
    n = len(corpus)
    whole, wanted = float(corpus.sum() + n), float(target.sum() + n)
    return np.array(
        [math.floor(scale * math.log((float(t) + 1) * whole / ((float(s) + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    spare = -bits.shape[1] % 64
    padded = np.pad(bits, ((0, 0), (0, spare)))
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """Bit planes of the gains in two's complement; the last one is the sign's."""
    bits = 1 + max(int(gain.max(initial=0)).bit_length(), int(~gain.min(initial=-1)).bit_length())
    return _packed((gain[None, :] >> np.arange(bits)[:, None] & 1).astype(bool))


def weights(row: np.ndarray, bucket: np.ndarray, n: np.ndarray, rows: int, planes: np.ndarray, buckets: int) -> np.ndarray:
    """Sum of gain * n for each row, by AND, popcount and powers of two over bit planes.

    (row, bucket) pairs are distinct. Only count planes that hold a bit are laid out, in blocks.
    """
    out = np.zeros(rows, np.int64)
    width = planes.shape[1]
    power = np.left_shift(1, np.arange(len(planes)), dtype=np.int64)
    power[-1] = -power[-1]
    for j in range(int(n.max(initial=0)).bit_length()):
        has = (n >> j & 1).astype(bool)
        owners, place = np.unique(row[has], return_inverse=True)
        at = bucket[has].astype(np.int64)
        edges = np.searchsorted(place, np.arange(0, len(owners) + 1))
        step = max(1, BLOCK // width)
        for low in range(0, len(owners), step):
            high = min(low + step, len(owners))
            part = slice(edges[low], edges[high])
            plane = np.zeros(((high - low), width), np.uint64)
            # No bit comes twice, so adding sets it.
            bit = np.left_shift(np.uint64(1), (at[part] & 63).astype(np.uint64))
            np.add.at(plane.reshape(-1), (place[part] - low) * width + (at[part] >> 6), bit)
            sums = np.zeros(high - low, np.int64)
            for k in range(len(planes)):
                sums += power[k] * np.bitwise_count(plane & planes[k]).sum(axis=1, dtype=np.int64)
            out[owners[low:high]] += sums << j
    return out


def resample(
    documents: DataFrame,
    target: DataFrame,
    keep: list[str],
    key: str = "doc_id",
    share: Fraction = SHARE,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
    run: int = RUN,
    buckets: int = BUCKETS,
) -> DataFrame:
    """`keep` columns of every row with n_features, weight, score, and the rank of the drawn ones.

    The shares of word runs in all `target` texts against those in all `documents` give the weights.
    Of the documents with at least `least_words` words the floor of `share` is drawn: those with the
    highest scores, ties to the smaller key (null first). Rows that are equal in both are drawn in
    any order. The hash of seed and key makes the noise, so a run can be repeated.

    Null and empty texts have no features and weight 0; a null key hashes like an empty one. Repeated
    rows are documents of their own. An empty target gives the weights of an evenly spread one; empty
    documents an empty table. Kept columns may have any name; n_features, weight, score and rank
    replace kept ones.
    """
    kept = Kept(keep)
    text_key = F.coalesce(named(key).cast("string"), F.lit(""))
    # In [0, 2^32); the noise is -ln(-ln(u)) of the middle of its step.
    step = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text_key), 256), 1, 8), 16, 10).cast("long")
    read = kept.take(documents, text=F.col("text"), key=named(key), h=step)
    table = stored(counted(read, [*kept.inner, "key", "h"], run, buckets), "features")
    gain = gains(totals(table, buckets), totals(counted(target, [], run, buckets), buckets))
    planes = gain_planes(gain)  # at most 64 planes of `buckets` bits, sent with the task

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bucket")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            found, n = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "n")]
            weight = weights(row, found, n, batch.num_rows, planes, buckets)
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weight)], names=[*batch.schema.names[:-2], "weight"])

    plain = [c for c in table.columns if c not in ("bucket", "n")]
    schema = StructType([*table.select(*plain).schema.fields, *StructType.fromDDL("weight long").fields])
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((F.col("h") + 0.5) / F.lit(4294967296.0))))
    scored = stored(
        table.select(*plain, "bucket", "n").mapInArrow(over, schema).withColumn("score", (F.col("weight") + noise).cast("long"))
        .withColumn("row", F.monotonically_increasing_id()),
        "scores",
    )
    enough = F.col("n_words") >= least_words
    number = scored.where(enough).count() * share.numerator // share.denominator
    placed = ranked(scored.where(enough), [F.desc("score"), F.asc("key"), F.asc("row")], "place", "llm-scores")
    drawn = placed.withColumn("rank", F.when(F.col("place") <= number, F.col("place"))).drop("place")
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return kept.give(drawn.unionByName(rest), ["n_features", "weight", "score", "rank"])
