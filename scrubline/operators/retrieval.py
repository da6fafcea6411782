"""Exact nearest vectors by a pivot index, and retrieval by vectors and words at once.

Unit vectors are dealt to the cell of their nearest pivot and sorted by their angle to it; a block is a run of
one cell and knows its least and greatest angle. The angle between a query and a vector is at least the
difference of their angles to the pivot, so a block whose best possible cosine is under a query's threshold
is ruled out as a whole. What is left is compared block by block, as products of matrices.

For retrieval by words too, blocks hold their own inverted lists with the greatest confidence in each. A
query's words and the block's cosine bound tell what a pattern can score at most: blocks, lists and patterns
that can't reach the k-th best so far are passed over, and cosines are worked out for the others only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .scratch import written

#: Pivots, rows of a block, and queries that go to all tasks at once.
PIVOTS, BLOCK_ROWS, QUERY_ROWS = 64, 512, 8_192
#: What rounding may take from a product.
SLACK = 1e-9

Batches = Iterator[pa.RecordBatch]
Top = list[tuple[float, int]]  # (score, id), best first


def _mapped(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def units(column: pa.ListArray, size: int) -> np.ndarray:
    """Vectors of ``size`` components as rows of length one."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return m / np.sqrt((m * m).sum(1))[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def usable(size: int):
    """Has the vector ``size`` finite components, and a length?"""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return (F.size("embedding") == size) & F.coalesce((square > 0) & (square < float("inf")), F.lit(False))


@dataclass(frozen=True)
class Index:
    """Blocks (domain, cell, low, high, ids, vectors, and what retrieval by words needs), the pivots and whose vectors they are."""

    blocks: DataFrame
    pivots: np.ndarray
    owners: np.ndarray


def build_index(base: DataFrame, pivots: int = PIVOTS) -> Index | None:
    """The index of base (vec_id, embedding, and domain, confidence and terms if they are there); None without a usable vector.

    Pivots are vectors of the base: which ones they are decides speed only. Vectors that are null, zero, not finite, or
    of another size than most pivots are left out, and so are rows without an id. Equal vectors spread over partitions.
    """
    words = "terms" in base.columns
    some = base.where("embedding IS NOT NULL AND vec_id IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "embedding").limit(pivots).collect()
    fit = [r for r in some if None not in r["embedding"] and 0 < sum(float(x) ** 2 for x in r["embedding"]) < float("inf")]
    sizes = [len(r["embedding"]) for r in fit]
    size = max(sizes, key=sizes.count, default=0)
    fit = [r for r in fit if len(r["embedding"]) == size]
    if not fit:
        return None
    rows = base.where(F.col("vec_id").isNotNull()).where(usable(size))
    centers = units(pa.array([r["embedding"] for r in fit], pa.list_(pa.float64())), size)
    columns = ["vec_id", "embedding", *(("domain", "confidence", "terms") if words else ())]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def place(batches: Batches) -> Batches:
        for batch in batches:
            near = angles(units(batch.column(1), size), centers)
            cell = near.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(near[np.arange(len(cell)), cell], pa.float64())], [*columns, "tie", "cell", "angle"])

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            names = batch.schema.names
            cells, told = batch.column(names.index("cell")).to_numpy(), batch.column(names.index("angle")).to_numpy()
            domains = batch.column(names.index("domain")).to_pylist() if words else [""] * len(cells)
            for a, b in runs(list(zip(domains, cells.tolist(), strict=True))):
                part = batch.slice(a, b - a)
                out = {
                    "domain": pa.array([domains[a]], pa.string()),
                    "cell": pa.array([cells[a]], pa.int32()),
                    "low": pa.array([told[a:b].min()], pa.float64()),
                    "high": pa.array([told[a:b].max()], pa.float64()),
                    "ids": pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    "vectors": pa.array([units(part.column(1), size).tobytes()], pa.binary()),
                }
                if words:
                    out |= _lists(part.column(names.index("confidence")).to_pylist(), part.column(names.index("terms")).to_pylist())
                yield pa.RecordBatch.from_pydict(out)

    numbered = rows.select(*columns, F.monotonically_increasing_id().alias("tie"))
    order = [*(["domain"] if words else []), "cell", "angle", "tie"]
    placed = _mapped(numbered, place, f"{kinds}, tie long, cell int, angle double").repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "domain string, cell int, low double, high double, ids binary, vectors binary"
    if words:
        kinds += ", confidence binary, terms array<string>, bounds array<double>, ends array<int>, places binary"
    return Index(written(_mapped(placed, pack, kinds), "index"), centers, np.array([r["vec_id"] for r in fit]))


def runs(keys: list) -> list[tuple[int, int]]:
    """(start, end) of runs of equal keys, of BLOCK_ROWS at most."""
    out, start = [], 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start] or i - start == BLOCK_ROWS:
            out.append((start, i))
            start = i
    return out


def _lists(confidence: list[float | None], terms: list[list[str] | None]) -> dict[str, pa.Array]:
    """The inverted lists of a block: each term's rows, and the greatest confidence among them."""
    sure = np.array([c or 0.0 for c in confidence])
    at: dict[str, list[int]] = {}
    for i, own in enumerate(terms):
        for t in sorted({x for x in own or () if x}):
            at.setdefault(t, []).append(i)
    names = sorted(at)
    return {
        "confidence": pa.array([sure.tobytes()], pa.binary()),
        "terms": pa.array([names], pa.list_(pa.string())),
        "bounds": pa.array([[float(sure[at[t]].max()) for t in names]], pa.list_(pa.float64())),
        "ends": pa.array([np.cumsum([len(at[t]) for t in names]).tolist()], pa.list_(pa.int32())),
        "places": pa.array([np.array([i for t in names for i in at[t]], np.int32).tobytes()], pa.binary()),
    }


def best_cosine(to_pivot: np.ndarray, low: float, high: float) -> np.ndarray:
    """The greatest cosine that vectors at angles low to high of a pivot can have with queries at ``to_pivot`` of it."""
    return np.cos(np.maximum(0.0, np.maximum(to_pivot - high, low - to_pivot)))


def merge(held: Top, new: Top, k: int) -> Top:
    return sorted(held + new, key=lambda x: (-x[0], x[1]))[:k]


def nearest(blocks: Iterator[dict], pivots: np.ndarray, ids: list[int], queries: np.ndarray, least: np.ndarray, k: int) -> tuple[list[Top], int]:
    """The k most similar rows to each query but its own, over ``least`` at first, and how many pairs were compared."""
    held: list[Top] = [[] for _ in ids]
    own, least, compared = np.array(ids), least.astype(np.float64).copy(), 0
    to_pivots = angles(queries, pivots)
    for b in blocks:
        alive = np.flatnonzero(best_cosine(to_pivots[:, b["cell"]], b["low"], b["high"]) >= least - SLACK)
        if not len(alive):
            continue
        rows = np.frombuffer(b["ids"], np.int64)
        vectors = np.frombuffer(b["vectors"], np.float64).reshape(len(rows), -1)
        compared += len(rows) * len(alive)
        hits = (queries[alive] @ vectors.T >= least[alive, None] - SLACK) & (own[alive, None] != rows)
        for i in np.flatnonzero(hits.any(1)):
            q, at = alive[i], np.flatnonzero(hits[i])
            # summed row by row: equal vectors have equal similarities, wherever they stand
            exact = (vectors[at] * queries[q]).sum(1)
            held[q] = merge(held[q], [(float(s), int(rows[a])) for s, a in zip(exact, at, strict=True) if s >= least[q]], k)
            if len(held[q]) == k:
                least[q] = max(least[q], held[q][-1][0])
    return held, compared


def search(index: Index, queries: DataFrame, k: int, least: float = -2.0, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of the k rows of highest cosine with each query (vec_id, embedding), none its own; ties by vec_id.

    Only similarities over ``least`` count. Thresholds begin with the k-th best of the pivots, which are rows too. Queries go
    to all tasks in blocks of ``query_rows``; the index is read once for each block. Unusable queries have no rows.
    """
    spark, pivots = queries.sparkSession, index.pivots
    size = pivots.shape[1]
    asked = queries.where(F.col("vec_id").isNotNull()).where(usable(size)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    found = None
    for rows in in_blocks(asked, query_rows):
        vectors = units(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), size)
        others = np.where(np.array([r["vec_id"] for r in rows])[:, None] == index.owners, -2.0, vectors @ pivots.T)
        begin = np.full(len(rows), least) if len(pivots) < k else np.maximum(least, np.sort(others, axis=1)[:, -k] - SLACK)
        sent = spark.sparkContext.broadcast(([r["vec_id"] for r in rows], vectors, begin))

        def run(batches: Batches, sent=sent) -> Batches:
            ids, vectors, begin = sent.value
            tops, _ = nearest((b for batch in batches for b in batch.to_pylist()), pivots, ids, vectors, begin, k)
            flat = [(q, v, s) for q, top in zip(ids, tops, strict=True) for s, v in top if s > least]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([f[0] for f in flat], pa.int64()), "vec_id": pa.array([f[1] for f in flat], pa.int64()), "similarity": pa.array([f[2] for f in flat], pa.float64())})

        out = _mapped(index.blocks.select("cell", "low", "high", "ids", "vectors"), run, "query_id long, vec_id long, similarity double")
        if found is not None:  # of more blocks than one, a block's broadcast goes when its result is written
            out = written(out, "nearest")
            sent.destroy()
        found = out if found is None else found.unionByName(out)
    return ranked(found, "similarity", k) if found is not None else spark.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")


def in_blocks(asked: DataFrame, query_rows: int) -> Iterator[list]:
    """The rows of ``asked`` in bounded blocks by a hash of their ids."""
    n = -(-asked.count() // query_rows)
    for part in [asked] if n <= 1 else (asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(2 * n)) == i) for i in range(2 * n)):
        if rows := part.collect():
            yield rows


def ranked(found: DataFrame, score: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# --- words and vectors ------------------------------------------------------------------------


@dataclass
class Counts:
    """Inverted-list entries read and passed over, and cosines worked out."""

    read: int = 0
    skipped: int = 0
    cosines: int = 0


def fused(blocks: Iterator[dict], pivots: np.ndarray, queries: list[tuple[int, str, list[str], np.ndarray]], k: int, alpha: float, least_cosine: float) -> tuple[list[Top], Counts]:
    """The k best (score, id) of each query (id, domain, terms, unit vector) among blocks of its domain, but its own."""
    held: list[Top] = [[] for _ in queries]
    counts = Counts()
    by_domain: dict[str, list[int]] = {}
    for i, q in enumerate(queries):
        by_domain.setdefault(q[1], []).append(i)
    to_pivots = angles(np.stack([q[3] for q in queries]), pivots)
    for b in blocks:
        asking = by_domain.get(b["domain"], [])
        if not asking:
            continue
        lists = dict(zip(b["terms"], range(len(b["terms"])), strict=True))
        ends = [0, *b["ends"]]
        places, sure, ids = np.frombuffer(b["places"], np.int32), np.frombuffer(b["confidence"], np.float64), np.frombuffer(b["ids"], np.int64)
        vectors = np.frombuffer(b["vectors"], np.float64).reshape(len(ids), -1)
        bounds = best_cosine(to_pivots[asking, b["cell"]], b["low"], b["high"])
        for i, cosine in zip(asking, bounds, strict=True):
            own, _, terms, vector = queries[i]
            share = (1 - alpha) / max(1, len(terms))
            # the query's lists in this block, short ones first
            mine = sorted((lists[t] for t in terms if t in lists), key=lambda j: (ends[j + 1] - ends[j], j))
            entries = [ends[j + 1] - ends[j] for j in mine]
            least = held[i][-1][0] if len(held[i]) == k else -1.0
            top = max(0.0, alpha * cosine) * sure.max()
            # what the lists from here on can add to a pattern; those at the end that can't lift one to the k-th best aren't traversed
            rest = np.concatenate([np.cumsum([share * b["bounds"][j] for j in mine][::-1])[::-1], [0.0]])
            if cosine <= least_cosine - SLACK or top + rest[0] < least - SLACK:
                counts.skipped += sum(entries)
                continue
            essential = int(np.argmax(top + rest < least - SLACK)) if top < least - SLACK else len(mine)
            if top < least - SLACK:
                at = np.unique(np.concatenate([places[ends[j] : ends[j + 1]] for j in mine[:essential]])) if essential else np.zeros(0, np.int32)
            else:
                at = np.arange(len(ids), dtype=np.int32)
            words = np.zeros(len(ids))
            for j in mine[:essential]:
                words[places[ends[j] : ends[j + 1]]] += 1
            counts.read += sum(entries[:essential])
            for m, j in enumerate(mine[essential:], essential):  # probed for patterns that still compete
                at = at[sure[at] * (max(0.0, alpha * cosine) + share * (words[at] + len(mine) - m)) >= least - SLACK]
                own_list = places[ends[j] : ends[j + 1]]
                spot = np.minimum(np.searchsorted(own_list, at), len(own_list) - 1)
                words[at] += own_list[spot] == at
                counts.read += min(len(at), len(own_list))
                counts.skipped += max(0, len(own_list) - len(at))
            at = at[(sure[at] * (max(0.0, alpha * cosine) + share * words[at]) >= least - SLACK) & (ids[at] != own)]
            counts.cosines += len(at)
            near = (vectors[at] * vector).sum(1)
            score = (alpha * near + (1 - alpha) * words[at] / max(1, len(terms))) * sure[at]
            held[i] = merge(held[i], [(float(s), int(ids[a])) for s, a, c in zip(score, at, near, strict=True) if c > least_cosine and s >= least], k)
    return held, counts


def hybrid_retrieve(queries: DataFrame, index: Index, k: int = 5, alpha: float = 0.5, least_cosine: float = 0.60, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, vec_id, score, rank): the k patterns of each query's domain by (alpha cosine + (1 - alpha) share of its words) x confidence.

    queries: (vec_id, domain, terms, embedding); a pattern's cosine must be over ``least_cosine``, and it isn't the query's own row. Terms
    count once; a query without terms is judged by its vector. Ties by vec_id. A null domain meets none.
    """
    spark, pivots = queries.sparkSession, index.pivots
    size = pivots.shape[1]
    asked = queries.where("vec_id IS NOT NULL AND domain IS NOT NULL").where(usable(size)).groupBy("vec_id").agg(F.min(F.struct("domain", F.array_sort(F.array_distinct(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: t != ""))).alias("terms"), "embedding")).alias("q"))
    found = None
    for rows in in_blocks(asked, query_rows):
        vectors = units(pa.array([r["q"]["embedding"] for r in rows], pa.list_(pa.float64())), size)
        sent = spark.sparkContext.broadcast([(r["vec_id"], r["q"]["domain"], r["q"]["terms"], v) for r, v in zip(rows, vectors, strict=True)])

        def run(batches: Batches, sent=sent) -> Batches:
            tops, _ = fused((b for batch in batches for b in batch.to_pylist()), pivots, sent.value, k, alpha, least_cosine)
            flat = [(q[0], v, s) for q, top in zip(sent.value, tops, strict=True) for s, v in top]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([f[0] for f in flat], pa.int64()), "vec_id": pa.array([f[1] for f in flat], pa.int64()), "score": pa.array([f[2] for f in flat], pa.float64())})

        out = written(_mapped(index.blocks, run, "query_id long, vec_id long, score double"), "hybrid")
        sent.destroy()
        found = out if found is None else found.unionByName(out)
    return ranked(found, "score", k) if found is not None else spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
