"""Benchmark decontamination: which short test items stand inside which long documents.

Words are lower-cased runs of letters and digits; a shingle is five words. An item is in a
document if the document holds at least 0.8 of the item's distinct shingles.

Search is by MinHash sketches partitioned by size. Of an item with n shingles the sketch holds
those with the smallest hashes, so many that a document that holds 0.8 of the item holds one of
the sketch: n - ceil(0.8 n) + 1. Items are partitioned by size into powers of two, and the largest
size of a partition sets its sketch length, so no size loses recall however long the documents
are. Hits are verified by counting whole shingles, compared as text.

All steps are DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_of, id_out, sized_broadcast, small, staged, text_of

SHINGLE_WORDS = 5
CONTAINMENT = 0.8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: str, width: int) -> Column:
    """All shingles of an array column, in order, repeats included."""
    joined = ", ".join(f"{words}[i + {k}]" for k in range(width))
    return F.expr(f"CASE WHEN size({words}) >= {width} THEN transform(sequence(0, size({words}) - {width}), i -> concat_ws(' ', {joined})) ELSE array() END")


def hashes_of(words: str, width: int) -> Column:
    joined = ", ".join(f"{words}[i + {k}]" for k in range(width))
    return F.expr(f"CASE WHEN size({words}) >= {width} THEN transform(sequence(0, size({words}) - {width}), i -> xxhash64(concat_ws(' ', {joined}))) ELSE array() END")


def item_shingles(benchmark: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(item, item_id, width, n, shingle): items of fewer words are one shingle of all their words; without words, none."""
    base = benchmark.select(id_of("item_id").alias("item_id"), words_of(text_of()).alias("w")).where("size(w) > 0").distinct()
    base = base.withColumn("item", F.xxhash64("item_id", "w")).withColumn("width", F.least(F.size("w"), F.lit(width)))
    parts = [base.where(F.col("width") == k).withColumn("s", F.array_distinct(shingles_of("w", k))) for k in range(1, width + 1)]
    return reduce(DataFrame.unionByName, parts).select("item", "item_id", "width", F.size("s").alias("n"), F.explode("s").alias("shingle"))


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(hash, item) for the smallest hashes of each item; how many, by the item's size partition."""
    upper = F.least(F.pow(F.lit(2), F.ceil(F.log2("n"))), F.lit(float(1 << 30)))
    length = (upper - F.ceil(F.lit(containment) * upper - 1e-9) + 1).cast("int")
    hashed = items.groupBy("item", "n").agg(F.array_sort(F.collect_set(F.xxhash64("shingle"))).alias("h"))
    return hashed.select("item", F.explode(F.slice("h", F.lit(1), F.greatest(length, F.lit(1)))).alias("hash"))


def _held(docs: DataFrame, benchmark: DataFrame, containment: float, width: int) -> DataFrame:
    """(id, h, item_id, n_shared, n) for each document, told by its id and its text's hash, and each item inside it."""
    items = staged(item_shingles(benchmark, width), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().limit(width).collect()) or [width]
    keys = staged(sketches(items, containment).select("hash").distinct(), "sketches")
    texts = docs.select(id_of().alias("id"), F.xxhash64(text_of()).alias("h"), text_of().alias("t"))
    hashed = F.explode(F.concat(*[hashes_of("w", k) for k in widths])).alias("hash")
    # a document is a candidate if it holds any item's sketch hash; only candidates' texts leave their task
    if small(keys):
        hits = texts.withColumn("w", words_of(F.col("t"))).select("id", "h", "t", hashed).join(F.broadcast(keys), "hash", "left_semi")
        again = staged(hits.groupBy("id", "h").agg(F.first("t").alias("t")), "candidates")
    else:
        hits = texts.withColumn("w", words_of(F.col("t"))).select("id", "h", hashed).join(keys, "hash", "left_semi")
        again = texts.join(sized_broadcast(staged(hits.select("id", "h").distinct(), "candidates")), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    again = again.withColumn("w", words_of(F.col("t")))
    spelled = again.select("id", "h", F.explode(F.array_distinct(F.concat(*[shingles_of("w", k) for k in widths]))).alias("shingle"))
    held = items if not small(items, 100_000) else F.broadcast(items)
    shared = spelled.join(held, "shingle").groupBy("id", "h", "item", "item_id", "n").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.lit(containment) * F.col("n") - 1e-9)


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document and each item inside it.

    Null texts are empty and match nothing; so do items without a word. An item of fewer than ``width`` words
    is one shingle of all its words. Items with the same id are held apart if their words differ. Rows with null or
    the same doc_ids are held apart if their texts differ, and are one document if not even those do. Other columns are
    ignored; empty tables give an empty result.
    """
    return _held(docs, benchmark, containment, width).select(
        id_out(F.col("id")).alias("doc_id"),
        id_out(F.col("item_id")).alias("item_id"),
        "n_shared",
        F.col("n").cast("long").alias("n_item"),
        (F.col("n_shared") / F.col("n")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item.

    Each row is judged by its own text; equal rows go or stay together, rows with null or repeated doc_ids don't touch
    each other. Null and empty texts stay. All columns pass, whatever their names (but those that begin with two
    underscores). Empty tables take nothing away.
    """
    gone = _held(docs, benchmark, CONTAINMENT, SHINGLE_WORDS).select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    gone = sized_broadcast(staged(gone, "leaks"))
    return docs.join(gone, (id_of() == F.col("__id")) & (F.xxhash64(text_of()) == F.col("__h")), "left_anti")
