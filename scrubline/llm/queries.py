"""The registered queries of the text operators: whole tables in, full results out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, exact_dedup, html_text, max_score, merkle, oracles, passages, pii, simhash, token_counts, toxicity, url_filter, zone_maps

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.concat_ws(" ", "host_words").alias("host_words"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path(name), public_tokenizers.PATTERN)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_50k.json") -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(name))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_maps.clustered(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return max_score.top_inner(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_personal_data": op10_personal_data,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_top_inner_products": op13_top_inner_products,
}

ORACLES: dict[str, str] = {
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
""",
    "op9_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest([array_to_string(w[i : i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s
       FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
""",
    "op11_centroid_clusters": oracles.clusters(),
    "op12_merkle_manifest": oracles.merkle(),
    "op13_top_inner_products": oracles.top_inner(),
}
