"""A stored table in buckets by a hash of its key: few changes rewrite few buckets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .scratch import discard, written


@dataclass(frozen=True)
class Stored:
    """A Parquet table under ``path``, partitioned by bucket; columns without the bucket are its rows.

    A change reads and writes only the buckets that its keys fall into. Their new contents are written aside first and then
    put in their place, so a change that dies is run again with the same result.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 256

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> Stored:
        """Write a table's first rows: shuffled by bucket once, a file or few for each."""
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(self.path)
        return self

    def read(self, touched: list[int] | None = None) -> DataFrame:
        every = self.spark.read.option("basePath", self.path).parquet(self.path)
        some = every if touched is None else every.where(F.col("bucket").isin(touched) if touched else F.lit(False))
        return some.drop("bucket")

    def change(self, keyed: DataFrame, how: Callable[[DataFrame], DataFrame]) -> list[int]:
        """The buckets that ``keyed`` (the keys, as columns) falls into, rewritten by ``how``."""
        touched = sorted(r[0] for r in keyed.select(self._bucket()).distinct().collect())
        if not touched:
            return touched
        after = written(how(self.read(touched)).withColumn("bucket", self._bucket()).repartition("bucket"), "buckets")
        # a bucket that has lost all its rows has no folder in what is written, and is emptied by hand
        left = {r[0] for r in after.select("bucket").distinct().collect()}
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in set(touched) - left:
            self._drop(b)
        discard(after)
        return touched

    def _drop(self, bucket: int) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def upsert(self, rows: DataFrame, update: list[str], order: str) -> list[int]:
        return self.change(rows, lambda old: tables.upsert(old, rows, list(self.keys), update, order))

    def insert_ignore(self, rows: DataFrame, order: str) -> list[int]:
        return self.change(rows, lambda old: tables.insert_ignore(old, rows, list(self.keys), order))

    def update_fields(self, updates: DataFrame, fields: list[str], rejects: Column) -> DataFrame:
        """Updates by id on a table whose key is the id; the rejected ones, which are written nowhere."""
        told: list[DataFrame] = []

        def how(old: DataFrame) -> DataFrame:
            new, refused = tables.update_fields(old, updates, fields, rejects)
            told.append(written(refused, "rejects"))
            return new

        self.change(updates, how)
        return told[0] if told else self.spark.createDataFrame([], f"{self.keys[0]} long, reasons array<string>")

    def resolve_flags(self, resolutions: DataFrame) -> list[int]:
        return self.change(resolutions, lambda old: tables.resolve_flags(old, resolutions).select(old.columns))

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(keys, lambda old: old.join(keys.select(*self.keys).distinct(), list(self.keys), "left_anti"))
