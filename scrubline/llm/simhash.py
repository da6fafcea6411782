"""SimHash near-deduplication by multi-index hashing.

A text's 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in
at most 2 bits have a segment in which they differ in at most 1. So each distinct fingerprint
looks up, for each segment, its value and the values with one zero bit set (of two values one bit
apart, one has a zero where the other has a one), and the whole distance is verified.

A segment value with many fingerprints would give the square of their number. There the rest of
the Hamming ball is enumerated too, and whole fingerprints are looked up: a constant number for
each fingerprint, with the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, id_of, id_out, mapped, sized_broadcast, staged, text_of, without

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
#: Fingerprints in a segment value from which whole balls are enumerated (a ball has 529).
BUSY = 256
_CHUNK = 50_000


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of UTF-8 text, as a signed 64-bit number; 0 without words."""
    parts = text.lower().split()  # for bytes both are ASCII only: A-Z, and [\x20\x09-\x0D]
    if not parts:
        return 0
    if len(parts) < words:
        parts, words = [b" ".join(parts)], 1
    total = len(parts) - words + 1
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, total, _CHUNK):
        part = parts[lo : lo + _CHUNK + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, print) of every document; null text as empty, null doc_id as the largest id."""
    return mapped(docs.select(id_of().alias("id"), text_of().cast("binary").alias("t")), _fingerprints, "id long, print long")


def _half(segment: int):
    """The 32 bits of a segment, and of the other one."""
    high, low = F.shiftrightunsigned("print", 32), F.col("print").bitwiseAND(0xFFFFFFFF)
    return (high, low) if segment == 0 else (low, high)


def links(prints: DataFrame, busy: int = BUSY) -> DataFrame:
    """(a, b), a <> b, of all distinct fingerprints (``print``, each once) that differ in at most 2 bits; a pair may repeat."""
    kinds = [prints.select("print", F.lit(s).alias("segment"), _half(s)[0].alias("value"), _half(s)[1].alias("rest")) for s in (0, 1)]
    entries = kinds[0].unionByName(kinds[1])
    flips = F.array(*[F.lit(0).cast("long")], *[F.lit(1 << i).cast("long") for i in range(32)])
    probes = entries.withColumn("flip", F.explode(flips)).where("value & flip = 0").withColumn("value", F.col("value").bitwiseOR(F.col("flip")))
    crowded = staged(entries.groupBy("segment", "value").count().where(F.col("count") > busy).select("segment", "value", F.lit(True).alias("busy")), "busy")
    near = "bit_count(a ^ b) BETWEEN 1 AND 2"
    if crowded.isEmpty():
        calm, hot = probes, None
    else:
        told = probes.join(sized_broadcast(crowded), ["segment", "value"], "left")
        calm, hot = told.where("busy IS NULL"), told.where("busy")
    # an unflipped pair meets from both sides: the smaller fingerprint asks
    found = (
        calm.select(F.col("print").alias("a"), "segment", "value", "flip")
        .join(entries.select(F.col("print").alias("b"), "segment", "value"), ["segment", "value"])
        .where("flip <> 0 OR a < b")
        .where(near)
        .select("a", "b")
    )
    if hot is None:
        return found
    one = [0] + [1 << i for i in range(32)]
    two = one + [x | y for x, y in combinations(one[1:], 2)]
    ball = F.when(F.col("flip") == 0, F.array(*[F.lit(m).cast("long") for m in two])).otherwise(F.array(*[F.lit(m).cast("long") for m in one]))
    whole = F.when(F.col("segment") == 0, F.shiftleft("value", 32).bitwiseOR(F.col("rest"))).otherwise(F.shiftleft("rest", 32).bitwiseOR(F.col("value")))
    asked = hot.withColumn("m", F.explode(ball)).withColumn("rest", F.col("rest").bitwiseXOR(F.col("m"))).select(F.col("print").alias("a"), whole.alias("b"))
    return found.unionByName(asked.where("a <> b").join(prints.select(F.col("print").alias("b")), "b").select("a", "b"))


def _groups(found: DataFrame) -> DataFrame:
    """(print, root, component) of the fingerprints in components of several rows; found: staged (id, print), component: the least id."""
    distinct = staged(found.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "prints")
    edges = links(distinct.select("print"))
    rooted = components(distinct.select(F.col("print").alias("node")), edges)
    rooted = staged(rooted.join(distinct, F.col("node") == F.col("print")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"), F.sum("copies").alias("members"))
    return staged(rooted.select("print", "root").join(least.where("members > 1"), "root").select("print", "root", "component"), "near")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest doc_id reachable over links.

    Null text is empty; texts without words have fingerprint zero and link like any other. A null doc_id
    comes after all others, and a null component_id stands for it. Equal rows stay apart; other columns are
    ignored; an empty table gives an empty table.
    """
    found = staged(fingerprints(docs), "simhash")
    told = found.join(sized_broadcast(_groups(found)), "print", "left")
    return told.select(
        id_out(F.col("id")).alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        id_out(F.coalesce("component", "id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, any one of those that tie.

    Null doc_ids come last; null and empty texts are one component. All columns pass, whatever their names (but those
    that begin with two underscores). An empty table gives an empty table.
    """
    # written once with a number for each row, so that equal rows can be told apart
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["row", "id", "print"])

    texts = rows.select(F.col("__row").alias("row"), id_of().alias("id"), text_of().cast("binary").alias("t"))
    found = staged(mapped(texts, run, "row long, id long, print long"), "simhash")
    groups = sized_broadcast(_groups(found.select("id", "print")), broadcast_rows)
    members = staged(found.join(groups, "print").select("root", "id", "row"), "members")
    first = members.groupBy("root").agg(F.min(F.struct("id", "row")).alias("b")).select("root", F.col("b.row").alias("first"))
    gone = staged(members.join(first, "root").where("row <> first").select("row"), "gone")
    return without(rows, gone, broadcast_rows, row=F.col("__row")).select(docs.columns)
