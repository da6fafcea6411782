"""Exact search for the highest inner products by MaxScore over inverted lists of vector components.

A term is a component and a sign: its list holds the vectors with such a value there, and its bound is the
largest size of these. A query's term gives at most its weight times that bound, and a vector scores at most
the sum over the query's terms. Partitions cut their vectors into shards with lists of their own; a query
goes through each shard like this: terms in order of what they can give; those at the end that together
can't reach the query's threshold are non-essential. Lists of the essential ones are traversed and summed up.
Vectors that with all non-essential terms still can't reach the threshold are left, the others are probed for
what is missing while they can compete. The k best of a shard raise the threshold for the next; the k best
of all partitions are merged at the end.

Thresholds begin with the k-th best of a bounded number of vectors: a query's true result is no worse,
whichever vectors these are.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, id_out, mapped, staged
from .integers import MOST, kind_of, matrix, usable

#: Vectors in a shard, queries that go to all tasks at once, vectors that thresholds begin with, and terms probed at once.
SHARD_ROWS, QUERY_ROWS, SEED_ROWS, PROBE_TERMS = 4_096, 8_192, 2_048, 8

Batches = Iterator[pa.RecordBatch]


class Shard:
    """Vectors by ascending id, their inverted lists and the bounds of the terms."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, kind: type = np.float64):
        order = np.argsort(ids, kind="stable")
        self.ids, self.cells = ids[order], cells[order].astype(kind)
        self.lists = {}
        size = self.cells.shape[1]
        self.bounds = np.zeros((2, size), self.cells.dtype)
        for sign in (0, 1):
            for d in range(size):
                values = self.cells[:, d] if sign == 0 else -self.cells[:, d]
                at = np.flatnonzero(values > 0)
                if len(at):
                    self.lists[sign, d] = (at, values[at])
                    self.bounds[sign, d] = values[at].max()

    def best(self, query_id: int, query: np.ndarray, k: int, least: int | None) -> tuple[list[tuple[int, int]], int]:
        """((score, id) of the k best vectors but the query's own, scores at ``least`` or more; values looked up)."""
        signs = (query < 0).astype(int)
        weights = abs(query)
        dims = np.flatnonzero(weights)
        gives = weights[dims] * self.bounds[signs[dims], dims]
        order = np.argsort(-gives, kind="stable")
        dims, gives = dims[order], gives[order]
        rest = np.concatenate([np.cumsum(gives[::-1])[::-1], np.zeros(1, gives.dtype)])  # what the terms from here on can give
        looked = 0
        if least is None or least <= 0:  # a vector in none of the lists may be among the best
            scores = self.cells @ query
            found = np.arange(len(self.ids))
            looked = self.cells.size
        else:
            # the terms before this one are essential: those from here on can't reach the threshold
            essential = int(np.searchsorted(-rest, -least, side="right"))
            sums = np.zeros(len(self.ids), self.cells.dtype)
            for d in dims[:essential]:
                for sign in (0, 1):  # lists of the other sign take away
                    if (sign, d) in self.lists:
                        at, values = self.lists[sign, d]
                        sums[at] += (weights[d] if sign == signs[d] else -weights[d]) * values
                        looked += len(at)
            found = np.flatnonzero(sums + rest[essential] >= least)
            scores = sums[found]
            for i in range(essential, len(dims), PROBE_TERMS):
                part = dims[i : i + PROBE_TERMS]
                scores = scores + self.cells[np.ix_(found, part)] @ query[part]
                looked += len(found) * len(part)
                still = scores + rest[min(i + PROBE_TERMS, len(dims))] >= least
                found, scores = found[still], scores[still]
        other = self.ids[found] != query_id
        found, scores = found[other], scores[other]
        if len(found) > k:  # found is by ascending id, so a stable order breaks ties by id
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            top = scores >= kth
            found, scores = found[top], scores[top]
        order = np.argsort(-scores, kind="stable")[:k]
        return [(int(scores[i]), int(self.ids[found[i]])) for i in order], looked


def _merge(held: list[tuple[int, int]], new: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(held + new, key=lambda x: (-x[0], x[1]))[:k]


def _cut(batches: Batches) -> Batches:
    """A shard (ids, cells, size) of each batch (vec_id, embedding)."""
    for batch in batches:
        if batch.num_rows:
            size = max(1, _longest(batch))
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            cells = matrix(batch.column(1), size)
            yield pa.RecordBatch.from_pydict({"ids": pa.array([ids.tobytes()], pa.binary()), "cells": pa.array([cells.tobytes()], pa.binary()), "size": pa.array([size], pa.int32())})


def _packed(vectors: DataFrame) -> DataFrame:
    """Shards of all vectors, staged: each partition cuts its own, so no vector is shuffled."""

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD_ROWS:
                yield from _cut(pa.Table.from_batches(held).combine_chunks().to_batches())
                held = []
        if held:
            yield from _cut(pa.Table.from_batches(held).combine_chunks().to_batches())

    return staged(mapped(vectors, run, "ids binary, cells binary, size int"), "shards")


def _shards(batches: Batches, queries: np.ndarray) -> Iterator[Shard]:
    """Shards with vectors as long as the queries: longer ones are cut, which leaves the products as they are."""
    size = queries.shape[1]
    for batch in batches:
        for ids, cells, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m = np.frombuffer(cells, np.int64).reshape(-1, own)[:, :size]
            m = np.pad(m, ((0, 0), (0, size - m.shape[1])))
            yield Shard(np.frombuffer(ids, np.int64), m, kind_of(queries, m))


def _tops(shards: Iterator[Shard], ids: list[int], queries: np.ndarray, least: list[int | None], k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """The k best of all shards for each query, and the values looked up."""
    held: list[list[tuple[int, int]]] = [[] for _ in ids]
    least, looked = list(least), 0
    for shard in shards:
        told = queries.astype(shard.cells.dtype)
        for i, q in enumerate(ids):
            new, n = shard.best(q, told[i], k, least[i])
            looked += n
            if new:
                held[i] = _merge(held[i], new, k)
                if len(held[i]) == k and (least[i] is None or held[i][-1][0] > least[i]):
                    least[i] = held[i][-1][0]
    return held, looked


def _begun(asked: DataFrame, vectors: DataFrame, k: int, seed_rows: int) -> DataFrame:
    """asked with ``least``: the k-th best score with some of the vectors, as text (null if these are fewer than k)."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id", "embedding").limit(seed_rows).collect()
    seeds = pa.RecordBatch.from_pydict({"vec_id": pa.array([r["vec_id"] for r in rows], pa.int64()), "embedding": pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))})

    def run(batches: Batches) -> Batches:
        for batch in batches:
            queries = matrix(batch.column(1), max(1, _longest(batch)))
            packed = list(_cut(iter([seeds])))
            tops, _ = _tops(_shards(iter(packed), queries), batch.column(0).to_pylist(), queries, [None] * len(queries), k)
            least = [str(t[-1][0]) if len(t) == k else None for t in tops]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.string())], ["vec_id", "embedding", "least"])

    return mapped(asked, run, f"vec_id long, embedding {asked.schema['embedding'].dataType.simpleString()}, least string")


def _longest(batch: pa.RecordBatch) -> int:
    return int(np.diff(batch.column(1).offsets.to_numpy()).max(initial=0))


def top_inner(vectors: DataFrame, queries: DataFrame, k: int = 10, query_rows: int = QUERY_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query with the vectors (all, if fewer), ties to the smaller vec_id.

    vectors and queries have vec_id and embedding; a query doesn't meet rows of its own vec_id. Null vectors and those with null or
    non-finite components take no part; where lengths differ, what a vector lacks is zero. Repeated rows of vectors count each; of
    query rows with one vec_id the smallest vector asks, and queries without a vec_id don't. A vector without a vec_id comes after
    others of its score. Other columns are ignored; an empty table gives an empty table. Scores beyond a long are the largest long.

    Queries are a stated set: they go to all tasks ``query_rows`` at a time, and shards are read once for each such block.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(id_of("vec_id").alias("vec_id"), "embedding").where(usable())
    asked = queries.where(F.col("vec_id").isNotNull()).where(usable()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    asked = staged(_begun(asked, vectors, k, seed_rows), "queries")
    shards = _packed(vectors)
    n = -(-asked.count() // query_rows)
    blocks = [asked] if n <= 1 else [asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(2 * n)) == i) for i in range(2 * n)]
    found = None
    for rows in (b.collect() for b in blocks):
        if not rows:
            continue
        column = pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))
        least = [None if r["least"] is None else int(r["least"]) for r in rows]
        sent = spark.sparkContext.broadcast(([r["vec_id"] for r in rows], matrix(column, max(1, max(len(r["embedding"]) for r in rows))), least))

        def run(batches: Batches, sent=sent) -> Batches:
            ids, told, least = sent.value
            tops, _ = _tops(_shards(batches, told), ids, told, least, k)
            flat = [(q, v, s) for q, top in zip(ids, tops, strict=True) for s, v in top]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([f[0] for f in flat], pa.int64()), "vec_id": pa.array([f[1] for f in flat], pa.int64()), "score": pa.array([Decimal(f[2]) for f in flat], pa.decimal128(38, 0))})

        out = mapped(shards, run, "query_id long, vec_id long, score decimal(38,0)")
        if n > 1:  # a block's broadcast goes when its result is written
            out = staged(out, "tops")
            sent.destroy()
        found = out if found is None else found.unionByName(out)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    within = F.greatest(F.least(F.col("score"), F.lit(MOST)), F.lit(-MOST - 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_out(F.col("vec_id")).alias("vec_id"), within.cast("long").alias("score"))
