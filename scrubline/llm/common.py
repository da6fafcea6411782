"""What the text operators share: Arrow batches, the shared scratch folder, filters by key, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..ship import ship

#: Rows up to which a table of a few fixed-width columns may be broadcast (about 16 MB).
BROADCAST_ROWS = 500_000
#: Bits of a Bloom filter for each key, its most bits (32 MB), and bits set by a key.
BLOOM_BITS, BLOOM_MOST, BLOOM_HASHES = 12, 1 << 28, 3
#: Rows are whole texts, so while a step is written fewer of them are held at once than by default.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 1_000}
#: Rows of a Parquet row group hold so many bytes at most, so that a writer holds little of the heap.
ROW_GROUP = 16 << 20

Batches = Iterator[pa.RecordBatch]


def mapped(df: DataFrame, run: Callable[[Batches], Batches], schema: str, rows: int = 1_000) -> DataFrame:
    """df.mapInArrow(run), with the package sent to the workers and batches cut to ``rows`` rows (rows are whole texts)."""
    ship(df.sparkSession)

    def cut(batches: Batches) -> Batches:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                yield b[lo : lo + rows]

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(cut(batches))
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Return a worker's free memory to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application inside the one in spark.checkpoint.dir, which driver and executors share.

    Where that isn't set a local master (as in tests) gets a temporary folder; a cluster gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_dir()
    path = f"{root.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if path not in _used:
        _used.add(path)
        atexit.register(_removed, spark, path)
    return path


_used: set[str] = set()
_local: list[str] = []


def _local_dir() -> str:
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _local[0]


def _removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, unless the session has ended."""
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside it readers and Arrow hold at most BATCHES rows at once; then the session is as it was."""
    before = {name: spark.conf.get(name) for name in BATCHES}
    try:
        for name, rows in BATCHES.items():
            if not 0 < int(before[name]) <= rows:
                spark.conf.set(name, str(rows))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs nothing.

    ``rows``: about how many there are, where that is known; few rows then go to few files. The folder goes with
    ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(4, rows // 100_000))
    with small_batches(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that no later step reads."""
    for t in tables:
        _removed(t.sparkSession, t._staged_at)


def freed(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark removes the shuffle files of steps that have ended; else they stay until its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` (cheap to read, such as a staged table) has at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if small(df, limit) else df


def _positions(key: str, bits: int) -> list[Column]:
    return [F.xxhash64(F.col(key), F.lit(i)).bitwiseAND(bits - 1) for i in range(BLOOM_HASHES)]


def slices_of(key: str, bits: int) -> list[Column]:
    """Positions of a key that is a hash itself: parts of its bits, which workers can take without Spark's hash."""
    return [F.shiftrightunsigned(key, 18 * i).bitwiseAND(bits - 1) for i in range(BLOOM_HASHES)]


def bloom(keys: DataFrame, key: str, rows: int, positions: Callable[[str, int], list[Column]] = _positions) -> np.ndarray:
    """A Bloom filter of a long column: bits built by the partitions, 32 MB at most on the driver and in each executor."""
    bits = min(BLOOM_MOST, 1 << max(15, (rows * BLOOM_BITS).bit_length()))
    at = keys.select(F.explode(F.array(*positions(key, bits))).alias("at")).select((F.col("at") + 1).alias("at"))  # bitmaps count from 1
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():
        lo = (r["bucket"] - 1) * 4096
        out[lo : lo + 4096] = np.frombuffer(r["map"], np.uint8)
    return out


def parted(df: DataFrame, key: str, keys: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of df that may have one of the keys, all others); ``keys`` is staged, its rows are distinct longs named as ``key``.

    Few keys are broadcast, and the first part is exact. More go to a Bloom filter of a fixed largest size, so
    that rows are told apart in the map stage and the others never shuffled; the first part then holds some rows
    without a key, and more of them the more keys there are over a tenth of a billion.
    """
    if small(keys, limit):
        told = F.broadcast(keys.withColumnRenamed(key, "__key"))
        return df.join(told, df[key] == F.col("__key"), "left_semi"), df.join(told, df[key] == F.col("__key"), "left_anti")
    table = bloom(keys, key, keys.count())
    ship(df.sparkSession)
    sent, bits = df.sparkSession.sparkContext.broadcast(table), len(table) * 8

    @F.arrow_udf(BooleanType())
    def may(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        hit = [(sent.value[x >> 3] >> (x & 7)) & 1 for x in (a.to_numpy(), b.to_numpy(), c.to_numpy())]
        return pa.array(np.logical_and.reduce(hit).astype(bool))

    held = may(*_positions(key, bits))
    return df.where(held), df.where(~held)


def without(df: DataFrame, gone: DataFrame, limit: int = BROADCAST_ROWS, **keys: Column) -> DataFrame:
    """df less the rows whose keys are in ``gone`` (staged, its columns are named as ``keys``, its first one is a long).

    Beyond a broadcast only rows that may have the first key are shuffled.
    """
    columns, first = df.columns, next(iter(keys))
    named = df.withColumns({f"__key_{k}": c for k, c in keys.items()})
    gone = gone.select([F.col(k).alias(f"__key_{k}") for k in keys])
    on = [f"__key_{k}" for k in keys]
    if small(gone, limit):
        return named.join(F.broadcast(gone), on, "left_anti").select(columns)
    some, rest = parted(named, f"__key_{first}", gone.select(f"__key_{first}").distinct(), limit)
    return rest.select(columns).unionByName(some.join(gone, on, "left_anti").select(columns))


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Stands for a null id, after all real ids.
NO_ID = (1 << 63) - 1


def id_of(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def id_out(col: Column) -> Column:
    return F.when(col != NO_ID, col)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``nodes``: root is the smallest node connected to it by ``edges`` (a, b).

    Alternating large-star and small-star rounds over edges between nodes. Each round is one
    aggregation with map-side minima, so that a hub costs a row for each task and not a group.
    Rounds are staged, and end when all pairs lead to roots; an error if they don't after ``max_rounds``.
    """
    pairs = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # done when each node has one pair, and none of those that pairs lead to has one
        ends = pairs.select(F.col("v").alias("x"), F.lit(1).alias("from_")).unionByName(pairs.select(F.col("u").alias("x"), F.lit(0).alias("from_")))
        each = ends.groupBy("x").agg(F.sum("from_").alias("out"), (F.count("*") - F.sum("from_")).alias("in_"))
        stat = each.agg(F.sum("out").alias("n"), F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in_") > 0))).alias("open")).first()
        if not stat["open"]:
            break
        n = stat["n"]
        # large star: every larger neighbour of v goes to the smallest of v's neighbourhood
        both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            pairs.select(F.col("u").alias("x"), F.col("v").alias("y"))
        )
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = staged(large, "large", n)
        # small star: the smaller neighbours of v and v itself go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(low, "v")
        before = pairs
        pairs = staged(
            moved.select(F.col("u").alias("v"), F.col("m").alias("u"))
            .unionByName(low.select("v", F.col("m").alias("u")))
            .where("v <> u")
            .distinct(),
            "small",
            n,
        )
        discard(before, large)
    else:
        raise RuntimeError(f"links are still open after {max_rounds} rounds")
    roots = pairs.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
