"""Clustering around centroids over vectors in blocks with boxes.

Vectors are ordered along a Hilbert curve through their dimensions of largest variance and cut into
blocks; a block carries the least and greatest value of each dimension, its zone map. In a round, the
distance of a centroid to a block's box is the least that any of its vectors can have, the distance to the
box's farthest corner the most. A centroid whose least is over another's most is nearest to none of the
block's vectors; the others are the block's candidates, and only these are compared, whole block at once.

All numbers are integers, so results are exact and don't depend on partitions. Blocks are written once; a
round reads them, and returns a sum for each centroid and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, staged
from .integers import kept, longs, matrix, numbers

#: Dimensions that the curve runs through, and the bits of each.
CURVE_DIMS, CURVE_BITS = 8, 7
#: Vectors in a block.
BLOCK_ROWS = 256
#: What a round sums up besides the dimensions: vectors, their distances, and pairs of vector and centroid compared.
COUNT, INERTIA, COMPARED = -1, -2, -3

Batches = Iterator[pa.RecordBatch]


def hilbert(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """The place on a Hilbert curve of each row of ``cells`` (numbers under 2^bits): neighbours on the curve are neighbours in space.

    From the highest bit down, each dimension's bit turns the first one's lower bits round or swaps them with its own;
    the Gray code of what is left, read across the dimensions bit by bit, is the place.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            up = (x[i] >> level) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << 1) | ((axis >> level) & 1)
    return place


def _spreads(vectors: DataFrame, size: int) -> list[tuple[int, int, int]]:
    """(dimension, least, greatest) of the dimensions of largest variance; partitions send a row for each dimension."""

    def run(batches: Batches) -> Batches:
        n, total, square, least, most = 0, np.zeros(size), np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0), size).astype(np.float64)
                n, total, square = n + len(m), total + m.sum(0), square + (m * m).sum(0)
                least, most = np.minimum(least, m.min(0)), np.maximum(most, m.max(0))
        if n:
            yield pa.RecordBatch.from_pydict({"d": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "total": total, "square": square, "least": least, "most": most})

    each = mapped(vectors.select("embedding"), run, "d int, n long, total double, square double, least double, most double")
    whole = each.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "total", "square")], F.min("least").alias("least"), F.max("most").alias("most"))
    rows = whole.select("d", "least", "most", (F.col("square") / F.col("n") - (F.col("total") / F.col("n")) ** 2).alias("variance")).collect()
    return [(r["d"], int(r["least"]), int(r["most"])) for r in sorted(rows, key=lambda r: (-r["variance"], r["d"]))[:CURVE_DIMS]]


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of vectors in Hilbert order, staged: (ids, cells, low, high); cells: the integers of all rows, low and high: the box.

    Partitions are ranges of the curve. Rows at one place are dealt out by a number of their own, so any number of equal
    vectors spreads over partitions.
    """
    axes = _spreads(vectors, size)

    def place(batches: Batches) -> Batches:
        for batch in batches:
            m = matrix(batch.column(1), size)
            cells = [np.minimum((m[:, d] - low) * ((1 << CURVE_BITS) - 1) // max(1, high - low), (1 << CURVE_BITS) - 1) for d, low, high in axes]
            keys = hilbert(np.stack(cells, axis=1)) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["vec_id", "embedding", "place", "curve"])

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(1), size)
                yield pa.RecordBatch.from_pydict(
                    {
                        "ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                        "cells": pa.array([m.tobytes()], pa.binary()),
                        "low": pa.array([m.min(0)], pa.list_(pa.int64())),
                        "high": pa.array([m.max(0)], pa.list_(pa.int64())),
                    }
                )

    kind = vectors.schema["embedding"].dataType.simpleString()
    numbered = vectors.select("vec_id", "embedding", F.monotonically_increasing_id().alias("place"))
    along = mapped(numbered, place, f"vec_id long, embedding {kind}, place long, curve long")
    ranged = along.repartitionByRange("curve", "place").sortWithinPartitions("curve", "place").select("vec_id", "embedding")
    return staged(mapped(ranged, pack, "ids array<long>, cells binary, low array<long>, high array<long>", rows=BLOCK_ROWS), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The numbers of the centroids that can be nearest to a vector in a box."""
    low, high, centers = numbers(low, high, centers)
    gap = np.maximum(np.maximum(low - centers, centers - high), 0)
    reach = np.maximum(abs(centers - low), abs(high - centers))
    return np.flatnonzero((gap * gap).sum(1) <= (reach * reach).sum(1).min())


def nearest(cells: np.ndarray, centers: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of the centroids ``among``; ties to the smaller number."""
    m, c = numbers(cells, centers[among])
    far = (m * m).sum(1)[:, None] - 2 * (m @ c.T) + (c * c).sum(1)
    at = far.argmin(1)
    return among[at], far[np.arange(len(m)), at]


def _assigned(batches: Batches, centers: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(ids, cells, numbers, distances, pairs compared) of each block."""
    for batch in batches:
        for ids, raw, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            among = candidates(np.array(low), np.array(high), centers)
            cells = np.frombuffer(raw, np.int64).reshape(len(ids), -1)
            yield ids, cells, *nearest(cells, centers, among), len(ids) * len(among)


def totals(packed: DataFrame, centers: list[list[int]]) -> dict[tuple[int, int], int]:
    """(centroid, dimension) -> sum over the vectors nearest to it; for dimensions COUNT, INERTIA and COMPARED see there."""
    told = np.array(centers, np.int64)

    def run(batches: Batches) -> Batches:
        out: dict[tuple[int, int], int] = {}

        def add(key: tuple[int, int], value) -> None:
            out[key] = out.get(key, 0) + int(value)

        for _, cells, at, far, pairs in _assigned(batches, told):
            add((0, COMPARED), pairs)
            for k in np.unique(at):
                own = cells[at == k]
                add((k, COUNT), len(own))
                add((k, INERTIA), sum(map(int, far[at == k])))
                wide = int(np.abs(own).max()) * len(own) < 1 << 62
                for d, v in enumerate(own.sum(0) if wide else own.astype(object).sum(0)):
                    add((k, d), v)
        yield pa.RecordBatch.from_pydict(
            {
                "k": pa.array([int(k) for k, _ in out], pa.int32()),
                "d": pa.array([d for _, d in out], pa.int32()),
                "v": pa.array([Decimal(v) for v in out.values()], pa.decimal128(38, 0)),
            }
        )

    each = mapped(packed, run, "k int, d int, v decimal(38,0)")
    return {(r["k"], r["d"]): int(r["v"]) for r in each.groupBy("k", "d").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}


def moved(centers: list[list[int]], sums: dict[tuple[int, int], int]) -> list[list[int]]:
    """Each centroid at the floor of the mean of its vectors; without vectors it stays."""
    return [[sums.get((k, d), 0) // n for d in range(len(c))] if (n := sums.get((k, COUNT), 0)) else c for k, c in enumerate(centers)]


def first_centers(vectors: DataFrame, size: int, k: int, seed: int) -> list[list[int]]:
    """The k vectors of smallest hash of seed and id; a null id comes last, ties by the vector."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("embedding", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "embedding").limit(k).select("embedding").collect()
    kind = pa.list_(pa.float64())
    return matrix(pa.array([r["embedding"] for r in rows], kind), size).tolist()


def clustered(vectors: DataFrame, size: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, watch: Callable[[int, dict], None] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors (vec_id, embedding) of ``size`` components.

    Each round assigns every vector to its nearest centroid and moves each centroid to the floor of its vectors' mean; then
    vectors are assigned once more. Rounds end early where no centroid moves, which changes nothing. Vectors that are null,
    of another size, or have null or non-finite components are left out; repeated rows count and come out each; a null
    vec_id passes. Fewer vectors than k give fewer centroids, an empty table an empty result. Sums beyond a long are the largest
    long. ``watch``: called with each round's number and sums.
    """
    vectors = kept(vectors, size)
    centers = first_centers(vectors, size, k, seed)
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centers:
        return vectors.sparkSession.createDataFrame([], kinds)
    packed = blocks(vectors, size)
    for n in range(rounds):
        sums = totals(packed, centers)
        if watch:
            watch(n, sums)
        before, centers = centers, moved(centers, sums)
        if centers == before:
            break
    else:
        sums = totals(packed, centers)
    told = np.array(centers, np.int64)
    inertia = [sums.get((i, INERTIA), 0) for i in range(len(centers))]
    whole, inertia = longs([sum(inertia)])[0], longs(inertia)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]

    def run(batches: Batches) -> Batches:
        for ids, _, at, far, _ in _assigned(batches, told):
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": pa.array(ids, pa.int64()),
                    "cluster": pa.array(at, pa.int32()),
                    "distance": pa.array(longs(far), pa.int64()),
                    "cluster_inertia": pa.array([inertia[i] for i in at], pa.int64()),
                    "inertia": pa.array([whole] * len(ids), pa.int64()),
                    "centroid_sha256": pa.array([names[i] for i in at], pa.string()),
                }
            )

    return mapped(packed, run, kinds)
