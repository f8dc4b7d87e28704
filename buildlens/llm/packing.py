"""Best-fit packing of tokenised documents by exact-complement hashing.

A sequence holds `capacity` tokens, so lengths are numbers from 1 to `capacity` and the
whole corpus is described by how many pieces there are of each: at most `capacity` counts,
whatever its size. The plan is made from those counts. Sums of one, two and three lengths
are indexed; the longest open length takes a combination that fills its gap exactly, as many
times as the counts allow; where no such combination is left, the longest length that fits
is added and the gap tried again. The plan says, for a range of the pieces of a length,
which sequences and offsets they get. Pieces then only need their number within their
length, which salted groups count in parallel.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from buildlens.llm.common import map_chunks, stored
from buildlens.llm.kept import keeping

CAPACITY = 2048
END_ID = 0
# Pieces of one length are numbered in so many groups at least; each is sorted by one task.
SALTS = 64


# The text pattern of the vocabulary and its special token.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Byte-level BPE of a tokenizer file (JSON), run by tiktoken.

    Its ids are those of the `tokenizers` library without special tokens added, at five times
    the speed: the file's vocabulary is read as byte strings, and its merges are in id order.
    Special tokens that stand in a text keep their ids, as that library has it.
    """
    if path not in _ENCODERS:
        import tiktoken

        ranks, special = byte_vocabulary(path)
        _ENCODERS[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def byte_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ids of byte strings, ids of special tokens) of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte_of = _byte_alphabet()
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    vocabulary = model["model"]["vocab"].items()
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary if token not in special}, special


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encode(texts: list[str], path: str) -> list[list[int]]:
    known = encoder(path)
    marks = known.special_tokens_set
    return [
        known.encode(t, allowed_special="all") if any(m in t for m in marks) else known.encode_ordinary(t)
        for t in texts
    ]


@keeping("piece", "start", "length", "ids")
def tokenize(
    documents: DataFrame, columns: list[str], path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """`columns` of every row for each of its pieces: piece, start, length and ids.

    ids are unsigned 32-bit little-endian numbers. A document ends with `end_id`; one longer
    than `capacity` is cut so that only its first piece may be shorter. A null text is empty:
    its one piece is the end id.
    """

    def run(texts: list) -> dict[str, object]:
        row, piece, start, length, ids = [], [], [], [], []
        for i, tokens in enumerate(encode(["" if t is None else t for t in texts], path)):
            tokens.append(end_id)
            data = np.array(tokens, "<u4").tobytes()
            n = len(tokens)
            head = n % capacity or min(n, capacity)
            for k, at in enumerate([0, *range(head, n, capacity)]):
                size = head if k == 0 else capacity
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(size)
                ids.append(data[4 * at : 4 * (at + size)])
        return {"_row": row, "piece": piece, "start": start, "length": length, "ids": ids}

    return map_chunks(documents, columns, ["text"], run, "piece int, start long, length long, ids binary")


@dataclass
class SumIndex:
    """Lengths with pieces left, and for sums of two and three of them a pair or triple that makes it.

    Counts only fall, so a sum that cannot be made any more is never looked at again; a witness
    that ran out is searched anew.
    """

    counts: np.ndarray
    pairs: dict[int, tuple | None] = field(default_factory=dict)
    triples: dict[int, tuple | None] = field(default_factory=dict)

    def times(self, parts: tuple) -> int:
        """How often the counts can make this combination."""
        return min(int(self.counts[p]) // parts.count(p) for p in set(parts))

    def find(self, total: int, wanted: int = 0) -> tuple | None:
        """Lengths with exactly this sum.

        Of one, two or three lengths the combination that can be made most often is taken, the
        shorter one among equals; one that can be made `wanted` times more need not be beaten.
        """
        best, most = None, 0
        for combination in (self._single, self._pair_kept, self._triple_kept):
            parts = combination(total)
            times = self.times(parts) if parts else 0
            if times > most:
                best, most = parts, times
            if most > wanted:
                break
        return best

    def _single(self, total: int) -> tuple | None:
        return (total,) if self.counts[total] > 0 else None

    def _pair_kept(self, total: int) -> tuple | None:
        return self._kept(self.pairs, total, self._pair)

    def _triple_kept(self, total: int) -> tuple | None:
        return self._kept(self.triples, total, self._triple)

    def _kept(self, index: dict, total: int, search) -> tuple | None:
        if total in index and (index[total] is None or self.times(index[total])):
            return index[total]
        index[total] = search(total)
        return index[total]

    def _pair(self, total: int, most: int | None = None) -> tuple | None:
        """The pair that can be made most often, with the longest first part (at most `most`) among equals."""
        low, high = -(-total // 2), min(total - 1, total if most is None else most)
        if low > high:
            return None
        a = np.arange(low, high + 1)
        b = total - a
        times = np.where(a == b, self.counts[a] // 2, np.minimum(self.counts[a], self.counts[b]))[::-1]
        at = int(np.argmax(times))
        return (int(a[::-1][at]), int(b[::-1][at])) if times[at] > 0 else None

    def _triple(self, total: int) -> tuple | None:
        """The triple with the longest first part for which a pair is left."""
        for a in np.flatnonzero(self.counts[: max(total - 1, 0)])[::-1]:
            if 3 * a < total:
                break
            self.counts[a] -= 1
            rest = self._pair(int(total - a), int(a))
            self.counts[a] += 1
            if rest:
                return (int(a), *rest)
        return None


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, number of such sequences) that use up the counts.

    counts[n] is the number of pieces of n tokens. The list's size depends on `capacity`
    alone: an entry is repeated until one of its lengths no longer suffices for another.
    """
    index = SumIndex(counts.astype(np.int64).copy())
    left, out = index.counts, []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    while (open_ := np.flatnonzero(left)).size:
        parts = [int(open_[-1])]
        left[parts[0]] -= 1
        gap = capacity - parts[0]
        while gap > 0:
            exact = index.find(gap, int(left[parts[0]]))
            if exact:
                parts += exact
                for p in exact:
                    left[p] -= 1
                break
            fitting = np.flatnonzero(left[: gap + 1])
            if not fitting.size:
                break
            parts.append(int(fitting[-1]))
            left[parts[-1]] -= 1
            gap -= parts[-1]
        more = min(int(left[p]) // parts.count(p) for p in set(parts))
        for p in parts:
            left[p] -= more
        out.append((tuple(parts), 1 + more))
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For ranges of the pieces of a length (sorted): length, first number, first sequence, offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, times in plan:
        offset = 0
        for p in parts:
            rows.append((p, used.get(p, 0), sequence, offset))
            used[p] = used.get(p, 0) + times
            offset += p
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T))


def place(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """`pieces` (with `length`) with sequence_id and offset; sequences are gapless from offset 0.

    `order` names columns that fix the order of pieces of one length; equal rows may swap.
    """
    spark = pieces.sparkSession
    salts = max(salts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    own = Window.partitionBy("length", "_salt").orderBy(*order)
    sizes = stored(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")), "salt-sizes")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    at = slots(plan_sequences(counts, capacity))
    numbered = (
        salted.withColumn("_number", F.row_number().over(own).cast("long") - 1)
        .join(bases, ["length", "_salt"])
        .withColumn("_number", F.col("_number") + F.col("_base"))
        .drop("_salt", "_base")
    )
    names = pieces.columns
    schema = StructType([*pieces.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    target = to_arrow_schema(schema)

    def run(batches):
        key = (at["length"] << 40) + at["first"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            slot = np.searchsorted(key, (length << 40) + number, "right") - 1
            sequence = at["sequence"][slot] + number - at["first"][slot]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(at["offset"][slot])], schema=target
            )

    return numbered.select(*names, "_number").mapInArrow(run, schema)


@keeping("piece", "start", "length", "ids", "sequence_id", "offset")
def pack(
    documents: DataFrame, columns: list[str], path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Every piece of every row with its ids, its sequence and its offset there."""
    pieces = stored(tokenize(documents, columns, path, capacity, end_id), "pieces")
    return place(pieces, [*columns, "piece", "ids"], capacity)
