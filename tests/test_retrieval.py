"""The pivot index and hybrid retrieval against all pairs, and how much they leave uncompared."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrubline.operators import retrieval, vectors


def clustered(n, clusters=40, size=24, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, size))
    return (centers[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, size))).astype(np.float32)


def plain_top(rows, queries, k, least=-2.0):
    unit = lambda v: np.array(v, np.float64) / np.sqrt((np.array(v, np.float64) ** 2).sum())
    out = {}
    for q, v in queries:
        sims = sorted(((-(unit(v) * unit(x)).sum(), i) for i, x in rows if i != q), key=lambda s: (round(s[0], 12), s[1]))
        out[q] = [i for s, i in sims[:k] if -s > least]
    return out


SCHEMA = "vec_id long, embedding array<float>"


def test_index_equals_all_pairs(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(700))]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # many equal vectors: ties by id
    odd = [(2000, None), (2001, [0.0] * 24), (2002, [1.0] * 5), (2003, [float("nan")] * 24), (None, rows[0][1])]
    base = spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA + ", cell string").repartition(3)
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    queries = spark.createDataFrame(asked + odd, SCHEMA)
    index = retrieval.build_index(base)
    for query_rows in (1000, 5):
        got = {}
        for r in retrieval.search(index, queries, 4, query_rows=query_rows).sort("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == plain_top(rows, asked, 4)
    near = {r.query_id: [r.vec_id] for r in vectors.nearest_within(queries, base, 0.85).collect()}
    assert near == {q: v for q, v in plain_top(rows, asked, 1, 0.85).items() if v}
    assert vectors.topk_cosine(queries, base.limit(0), 3).count() == 0 == vectors.topk_cosine(queries.limit(0), base, 3).count()


def test_whole_cells_are_ruled_out(spark):
    """On vectors with structure, far fewer pairs are compared than there are, at two sizes."""
    for n in (4_000, 16_000):
        rows = clustered(n)
        base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], SCHEMA)
        index = retrieval.build_index(base)
        ids = list(range(0, n, n // 40))
        unit = retrieval.units(pa.array([rows[i].tolist() for i in ids], pa.list_(pa.float64())), 24)
        blocks = index.blocks.collect()
        _, compared = retrieval.nearest((b.asDict() for b in blocks), index.pivots, ids, unit, np.full(len(ids), 0.9), 1)
        assert compared < 0.25 * n * len(ids)


def plain_hybrid(rows, queries, k, alpha, least):
    out = {}
    for q, domain, terms, v in queries:
        scored = []
        for i, d, sure, words, x in rows:
            cosine = float(np.dot(v, x) / np.sqrt(np.dot(v, v) * np.dot(x, x)))
            if d == domain and i != q and cosine > least:
                scored.append((-(alpha * cosine + (1 - alpha) * len(set(terms) & set(words)) / max(1, len(set(terms)))) * sure, i))
        out[q] = [i for _, i in sorted(scored, key=lambda s: (round(s[0], 12), s[1]))[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.fixture(scope="module")
def patterns():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    common = ["the", "of"]
    return [(i, rng.choice("ab"), rng.choice((0.2, 0.5, 0.8, 0.95)), rng.sample(vocabulary, rng.randrange(6)) + common * rng.randrange(2), v.astype(float)) for i, v in enumerate(clustered(1200, clusters=6))]


PATTERN = "vec_id long, domain string, confidence double, terms array<string>, embedding array<double>"


@pytest.mark.parametrize(("alpha", "least"), [(0.5, 0.6), (0.1, 0.0), (1.0, 0.6)])
def test_hybrid_equals_all_patterns(spark, patterns, alpha, least):
    base = spark.createDataFrame([(i, d, c, t, v.tolist()) for i, d, c, t, v in patterns] + [(5000, None, 0.9, ["w1"], patterns[0][4].tolist()), (5001, "a", None, None, patterns[1][4].tolist()), (5002, "a", 0.9, ["w1"], None)], PATTERN)
    asked = [(i, d, t, v) for i, d, _, t, v in patterns[::60]]
    queries = spark.createDataFrame([(i, d, 0.0, t, v.tolist()) for i, d, t, v in asked] + [(6000, None, 0.0, ["w1"], [1.0] * 24)], PATTERN)
    index = retrieval.build_index(base)
    for query_rows in (100, 4):
        got = {}
        for r in retrieval.hybrid_retrieve(queries, index, 5, alpha, least, query_rows).sort("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == plain_hybrid([p for p in patterns] + [(5001, "a", 0.0, [], patterns[1][4])], asked, 5, alpha, least)


def test_lists_are_passed_over_by_their_bounds(spark, patterns):
    index = retrieval.build_index(spark.createDataFrame([(i, d, c, t, v.tolist()) for i, d, c, t, v in patterns], PATTERN))
    asked = [(i, d, sorted(set(t) | {"the", "of"}), v / np.sqrt((v * v).sum())) for i, d, _, t, v in patterns[::60]]
    _, counts = retrieval.fused((b.asDict() for b in index.blocks.collect()), index.pivots, asked, 5, 0.5, 0.6)
    assert counts.skipped > counts.read and counts.cosines < 0.5 * len(patterns) * len(asked)


def test_spread_of_ids_does_not_matter(spark):
    assert retrieval.runs(["a", "a", "b"]) == [(0, 2), (2, 3)] and retrieval.runs([]) == []
    one = spark.createDataFrame([(7, [1.0, 0.0])], SCHEMA)
    assert vectors.topk_cosine(one, one, 3).count() == 0
    assert vectors.topk_cosine(one, one.unionByName(one.withColumn("vec_id", F.lit(8).cast("long"))), 3).first().vec_id == 8
