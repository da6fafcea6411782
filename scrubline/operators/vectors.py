"""Nearest vectors by cosine similarity, and the table of known addresses."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_blank
from . import retrieval
from .tables import upsert

def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two arrays, over their own values; null for a zero vector."""
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, v) -> s + v)"
    norm = "aggregate({0}, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)"
    return F.expr(f"try_divide({dot}, sqrt({norm.format(a)}) * sqrt({norm.format(b)}))")


def topk_cosine(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of the k nearest rows of base to each query, exactly; ties by vec_id."""
    index = retrieval.build_index(base)
    return retrieval.search(index, queries, k) if index else _none(base)


def nearest_within(queries: DataFrame, base: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(query_id, vec_id, similarity): the nearest row over the threshold, exactly; queries without one are left out."""
    index = retrieval.build_index(base)
    return (retrieval.search(index, queries, 1, threshold) if index else _none(base)).drop("rank")


def _none(base: DataFrame) -> DataFrame:
    return base.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")


def candidates(queries: DataFrame, base: DataFrame, threshold: float, tables: int = 8, bucket: float = 0.5) -> DataFrame:
    """Like nearest_within over pairs that share a bucket of random projections; recall is below one and depends on tables and bucket."""
    unit = F.expr("transform(embedding, x -> CAST(x AS DOUBLE) / sqrt(aggregate(embedding, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)))")
    a, b = (df.select("vec_id", array_to_vector(unit).alias("v")) for df in (queries, base))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=1).fit(b)
    pairs = model.approxSimilarityJoin(a, b, (2 * (1 - threshold)) ** 0.5, "distance")
    return pairs.select(F.col("datasetA.vec_id").alias("query_id"), F.col("datasetB.vec_id").alias("vec_id"), (1 - F.col("distance") ** 2 / 2).alias("similarity")).where("query_id <> vec_id")


def address_upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: list[str], order: str) -> DataFrame:
    """Known addresses after rows: equal ones (null equal to null) are updated, others added; rows without an address are left out."""
    return upsert(target, rows.where(~is_blank(keys[0])), keys, update, order)
