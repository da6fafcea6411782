"""Exact deduplication by exchange of Golomb-coded fingerprints.

1. Each partition sorts the fingerprints of its texts and cuts them by owner (a range of the
   fingerprint space). What an owner gets is a Golomb-Rice code of the sorted distinct values.
2. An owner decodes what all blocks sent, and answers each block with a bitmap: bit i is set if
   the block's i-th value also came from elsewhere.
3. Only rows with a value whose bit is set (or that repeats inside its block) are suspects; they
   are told from the others in the map stage, and written with a row number each. Their texts
   are grouped by the whole text, so equality is of bytes; the grouping combines in the map
   stage, and a text with a million copies sends one row for each task. No other text is shuffled.

A block of 10,000 texts sends some 45 KB, whatever the length of its texts. There are so many owners that
one decodes about OWNER_ROWS values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NO_ID, id_of, id_out, mapped, parted, sized_broadcast, staged, text_of

FINGERPRINT_BITS = 52
BLOCK_ROWS, OWNER_ROWS = 200_000, 2_000_000
#: Over all ids: (code points, id) as one number.
SPAN = "CAST(18446744073709551616 AS DECIMAL(20,0))"


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative values: a byte for k, the unary quotients of the gaps, their k-bit rests."""
    if not len(values):
        return b"\x00"
    gaps = np.diff(values, prepend=0).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / len(values)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rests = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + np.packbits(np.concatenate([unary, rests.ravel()])).tobytes()


def rice_decode(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, dtype=np.int64)
    k = blob[0]
    bits = np.unpackbits(np.frombuffer(blob, dtype=np.uint8, offset=1))
    ends = np.flatnonzero(bits)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rests = bits[ends[-1] + 1 : ends[-1] + 1 + n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotients << k) + (rests << np.arange(k, dtype=np.int64)).sum(axis=1))


def squeezed(col: str | Column = "text") -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text_of(col), "[\\x20\\x09-\\x0D]+", "")


def _blocks(owners: int, bits: int, block_rows: int):
    """Rows (block, owner, n, blob, twice): twice is a bitmap of the values that more than one row of the block has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        width = -(-(1 << bits) // owners)

        def block(prints: np.ndarray, number: int) -> pa.RecordBatch:
            values, times = np.unique(prints, return_counts=True)
            owner = values // width
            rows: list[tuple] = []
            for o in np.unique(owner):
                lo, hi = np.searchsorted(owner, [o, o + 1])
                rows.append(((part << 24) + number, int(o), int(hi - lo), rice_encode(values[lo:hi] - o * width), np.packbits(times[lo:hi] > 1).tobytes()))
            kinds = (("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("blob", pa.binary()), ("twice", pa.binary()))
            return pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})

        held, count = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            count += batch.num_rows
            if count >= block_rows:
                yield block(np.concatenate(held), number)
                held, count, number = [], 0, number + 1
        if count:
            yield block(np.concatenate(held), number)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's work: of all blocks' values, which came from two blocks or more. One bitmap for each block."""
    held: dict[int, list[tuple[int, int, bytes]]] = {}
    for batch in batches:
        for block, owner, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(owner, []).append((block, n, blob))
    for owner, sent in held.items():
        decoded = [rice_decode(blob, n) for _, n, blob in sent]
        values, times = np.unique(np.concatenate(decoded), return_counts=True)
        shared = values[times > 1]
        maps = [np.packbits(np.isin(v, shared, assume_unique=True)).tobytes() for v in decoded]
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([b for b, _, _ in sent], pa.int64()),
                "owner": pa.array([owner] * len(sent), pa.int32()),
                "bitmap": pa.array(maps, pa.binary()),
            }
        )


def _suspects(owners: int, bits: int):
    """The values of a block whose bit is set in the owner's answer, or that are there twice."""
    width = -(-(1 << bits) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, n, blob, twice, bitmap in zip(*(batch.column(c).to_pylist() for c in ("owner", "n", "blob", "twice", "bitmap")), strict=True):
                hit = np.frombuffer(twice, np.uint8) | np.frombuffer(bitmap, np.uint8)
                values = rice_decode(blob, n)[np.unpackbits(hit)[:n].astype(bool)] + owner * width
                yield pa.RecordBatch.from_pydict({"print": pa.array(values, pa.int64())})

    return run


def suspects(prints: DataFrame, owners: int | None = None, bits: int = FINGERPRINT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(print), each once, of the fingerprints that more than one row has; ``prints``: staged (print), a row for each text."""
    owners = owners or max(16, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() // OWNER_ROWS)
    blocks = staged(mapped(prints, _blocks(owners, bits, block_rows), "block long, owner int, n int, blob binary, twice binary", BLOCK_ROWS), "golomb")
    answers = mapped(blocks.select("block", "owner", "n", "blob").repartition(owners, "owner"), _answers, "block long, owner int, bitmap binary")
    told = blocks.join(answers, ["block", "owner"]).select("owner", "n", "blob", "twice", "bitmap")
    return staged(mapped(told, _suspects(owners, bits), "print long").distinct(), "suspects")


def _marked(docs: DataFrame, broadcast_rows: int) -> DataFrame:
    """docs with __keep, __size, __kept, __sha behind its columns."""
    mine = F.expr(f"CAST({NO_ID} - coalesce(doc_id, {NO_ID}) AS DECIMAL(20,0))")
    full = docs.withColumn("__print", F.xxhash64(squeezed()).bitwiseAND((1 << FINGERPRINT_BITS) - 1))
    seen = suspects(staged(full.select(F.col("__print").alias("print")), "prints")).withColumnRenamed("print", "__print")
    some, rest = parted(full, "__print", seen, broadcast_rows)
    sha = F.sha2(squeezed(), 256).alias("__sha")
    rest = rest.select(*docs.columns, id_of().alias("__keep"), F.lit(1).cast("long").alias("__size"), F.lit(True).alias("__kept"), sha)
    # most code points, then least id, as one number, so that grouping keeps fixed-width state
    value = (F.length(text_of()).cast("decimal(38,0)") * F.expr(SPAN) + mine).cast("decimal(38,0)")
    some = staged(some.select(*docs.columns, sha, value.alias("__value"), F.monotonically_increasing_id().alias("__row")), "rows")
    groups = some.groupBy(squeezed().alias("__squeezed")).agg(F.count("*").alias("__size"), F.max("__value").alias("__best"))
    groups = staged(groups.where("__size > 1").select(F.sha2("__squeezed", 256).alias("__sha"), "__size", "__best"), "groups")
    # of rows with the same length and id one stays
    told = sized_broadcast(groups, broadcast_rows // 4)
    first = some.select("__sha", "__value", "__row").join(told, "__sha").where("__value = __best").groupBy("__sha").agg(F.min("__row").alias("__first"))
    groups = staged(groups.join(first, "__sha"), "kept")
    some = some.join(sized_broadcast(groups, broadcast_rows // 4), "__sha", "left")
    keep = F.expr(f"CAST({NO_ID} - __best % {SPAN} AS LONG)")
    some = some.select(*docs.columns, F.coalesce(keep, id_of()).alias("__keep"), F.coalesce("__size", F.lit(1)).alias("__size"), F.coalesce(F.col("__row") == F.col("__first"), F.lit(True)).alias("__kept"), "__sha")
    return rest.unionByName(some)


def exact_groups(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with keep_id, group_size, kept, text_sha256 added; ``docs`` needs doc_id and text, other columns pass.

    Rows are equal if their texts are without ``[\\x20\\x09-\\x0D]``; null text is empty, and empty texts are
    equal. The row with the most code points stays, then the smallest doc_id; a null doc_id comes last and a
    null keep_id stands for it. Rows with the same doc_id and text count singly: just one row of a group is kept,
    any one of those that tie. Columns named like the four added ones give way to them. An empty table gives an empty table.
    """
    docs = docs.select([c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")])
    added = (id_out(F.col("__keep")).alias("keep_id"), F.col("__size").alias("group_size"), F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"))
    return _marked(docs, broadcast_rows).select(*docs.columns, *added)


def drop_copies(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each set of equal texts, as exact_groups() tells them: the one that is kept.

    Null texts are equal to empty ones, so one row of all of them stays. Of equal rows, null or repeated doc_ids too, one
    stays. All columns pass, whatever their names (but those that begin with two underscores). An empty table gives an empty table.
    """
    return _marked(docs, broadcast_rows).where("__kept").select(docs.columns)
