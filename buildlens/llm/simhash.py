"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints that differ in at most `radius` bits are linked. Every bit position gets a
vector of `radius + 1` bits, none of them zero; mask v keeps the positions whose vector has
an odd number of ones in common with v. The positions in which two fingerprints differ span
at most `radius` of the `radius + 1` dimensions, so some v is orthogonal to them all: under
that mask the fingerprints are equal. The 2^(radius+1) - 1 masks therefore find every pair
within the radius, without any chance of a miss.

Equal fingerprints are one node from the start. A bucket of few nodes is compared pair by
pair. A bucket of many is never: two of its nodes within radius 2 differ only in bits that
the mask dropped, so both are one flip of such a bit away from a common point (or are that
point). Every node lists those points, and nodes that share a point are linked; a point has
at most as many nodes as the mask dropped bits, however large the bucket. For a radius
beyond 2 the nodes of a large bucket list points up to radius/2 flips away.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import components, map_chunks, stored
from buildlens.llm.kept import keeping

SHINGLE_WORDS = 3
RADIUS = 2
BITS = 64
SEED = 42
# Buckets of up to this many nodes are compared pair by pair; beyond, by shared points.
PAIRWISE = 48


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as unsigned 64-bit numbers."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(BITS)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, 1 << (radius + 1))
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(texts: list, shingle: int) -> np.ndarray:
    hashes: list[int] = []
    sizes: list[int] = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
        if len(words) > shingle:
            parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
        else:
            parts = [b" ".join(words)] if words else []
        before = len(hashes)
        hashes += [digest(p, SEED) for p in parts]
        sizes.append(len(hashes) - before)
    size = np.array(sizes, np.int64)
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        value = np.array(hashes, np.uint64)
        start = (np.cumsum(size) - size)[full]
        ones = np.empty((int(full.sum()), BITS), np.int64)
        for bit in range(BITS):
            ones[:, bit] = np.add.reduceat(((value >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), start)
        most = ones * 2 > size[full][:, None]
        out[full] = np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprints(documents: DataFrame, columns: list[str], shingle: int = SHINGLE_WORDS) -> DataFrame:
    """`columns` of every row and `fp`, the fingerprint of its whole text as a signed long.

    A text of fewer words than a shingle is one shingle; one without words (or null) has zero.
    """
    return map_chunks(documents, columns, ["text"], lambda texts: {"fp": _fingerprints(texts, shingle)}, "fp long")


def links(nodes: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that connect all pairs within the radius."""
    known = masks(radius)
    keyed = stored(
        nodes.select(
            "fp",
            F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in known])).alias("t", "key"),
        ),
        "buckets",
    )
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keyed.join(sizes, ["t", "key"]), "met")

    few = met.where(F.col("n") <= pairwise).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = (
        few.select("fps", F.explode("fps").alias("a"))
        .select("a", F.explode("fps").alias("b"))
        .where((F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    )
    half = -(-radius // 2)
    flips = []
    for m in known:
        free = [i for i in range(BITS) if not m >> i & 1]
        flips.append(
            F.array(*[F.lit(_signed(sum(1 << i for i in c))) for k in range(half + 1) for c in combinations(free, k)])
        )
    points = met.where(F.col("n") > pairwise).select(
        "t", "fp", F.explode(F.element_at(F.array(*flips), F.col("t") + 1)).alias("flip")
    ).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    shared = points.groupBy("t", "point").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("fps"))
    if radius % 2:  # two half radii are one bit more than the radius: the pairs of a point are compared
        near = shared.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b")).where(
            (F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        )
    else:  # any two nodes of a point are within the radius
        near = shared.select("b", F.explode("fps").alias("a")).where("a <> b")
    return pairs.select("a", "b").unionByName(near.select("a", "b"))


@keeping("fp", "root", "component_id")
def near_duplicates(
    documents: DataFrame, columns: list[str], shingle: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """`columns` of every row, `fp`, `root` and `component_id`; `documents` needs doc_id and text.

    `root` is the smallest fingerprint that links reach and names the component. component_id is
    the smallest doc_id in it, the row's own included; null if no row of it has a doc_id. Equal
    texts share a fingerprint and so a component. Null and empty texts have fingerprint 0 and are
    linked like any others; an empty table gives an empty one; kept columns may have any name.
    """
    rows = stored(fingerprints(documents, [*columns, "doc_id"], shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius), "links")
    grouped = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    grouped = stored(grouped, "grouped")
    firsts = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    members = stored(grouped.select("fp", "root").join(firsts, "root"), "members")
    return rows.join(members, "fp")
