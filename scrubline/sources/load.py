"""Tables and seed data: corrections, query packs, column metadata, postal code pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import POSTAL_LETTERS, lookup
from ..operators import tables

# The framework's own tables.
SYSTEM_TABLES = (
    "raw_data", "cleaned_data", "audit_log", "flags", "column_metadata", "column_profiles", "spell_corrections", "query_pattern_memory",
    "source_registry", "plan_cache", "search_cache", "address_lookup",
)


def read_table(spark: SparkSession, kind: str, place: str, **options: str) -> DataFrame:
    """A table by kind: parquet, csv, json, orc, a catalog table, or jdbc with partition options."""
    if kind == "table":
        return spark.table(place)
    if kind == "jdbc":
        return spark.read.format("jdbc").option("dbtable", place).options(**options).load()
    return spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options).load(place)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def corrections(rows: DataFrame, domain: str) -> DataFrame:
    """(wrong, fixed, source, confidence, domain) of rows (wrong, right, source, confidence): trimmed, lower-cased, defaults filled in."""
    return rows.select(F.lower(F.trim("wrong")).alias("wrong"), F.lower(F.trim("right")).alias("fixed"), F.coalesce("source", F.lit("manual_seed")).alias("source"), F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"), F.lit(domain).alias("domain"))


def load_corrections(spark: SparkSession, path: str, domain: str, target: DataFrame) -> DataFrame:
    """target (wrong, fixed, source, confidence, domain) and the corrections of a CSV file with a header, where it has no row for a
    word in the domain; of a word that the file repeats the first by its correction counts. Lines without a word are left out."""
    rows = spark.read.option("header", "true").schema("wrong string, right string, source string, confidence double").csv(path)
    return tables.insert_ignore(target, corrections(rows, domain).where("coalesce(wrong, '') <> '' AND coalesce(fixed, '') <> ''"), ["wrong", "domain"], "fixed")


def trusted_sources(packs: DataFrame, registry: DataFrame, trust: float = 0.8) -> DataFrame:
    """registry (domain, url_host, trust_score) and the trusted sources of packs (domain, trusted_sources) that it doesn't know."""
    rows = packs.select("domain", F.explode("trusted_sources").alias("url_host"), F.lit(trust).alias("trust_score"))
    return tables.insert_ignore(registry, rows, ["domain", "url_host"], "trust_score")


def load_column_metadata(nested: DataFrame, target: DataFrame) -> DataFrame:
    """target (domain, table_name, column_name, description, gap_detection) after an upsert of nested metadata."""
    return tables.upsert(target, column_metadata(nested), ["domain", "table_name", "column_name"], ["description", "gap_detection"], "description")


def query_packs(packs: DataFrame) -> DataFrame:
    """(domain, gap_type, query_template) of packs (domain, gap_types: map of gap to seed queries)."""
    return packs.select("domain", F.explode("gap_types").alias("gap_type", "seeds")).select("domain", "gap_type", F.explode("seeds").alias("query_template"))


def column_metadata(nested: DataFrame) -> DataFrame:
    """(domain, table_name, column_name, description, gap_detection as JSON) of (domain, tables: map of table to columns)."""
    rows = nested.select("domain", F.explode("tables").alias("table_name", "columns")).select("domain", "table_name", F.explode("columns").alias("c"))
    return rows.select("domain", "table_name", F.col("c.column").alias("column_name"), "c.description", F.to_json("c.gap_detection").alias("gap_detection"))


def fsa_cells(pages: DataFrame, column: str = "html") -> DataFrame:
    """(fsa, municipality, province) of table cells with a bold code; what isn't assigned, or reads like a note, is left out."""
    cells = pages.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<td[^>]*>(.*?)</td>"))).alias("cell"))
    code = F.trim(F.regexp_replace(F.regexp_extract("cell", r"(?s)<b[^>]*>(.*?)</b>", 1), "<[^>]*>", ""))
    rest = F.regexp_replace(F.regexp_replace("cell", r"(?s)<b[^>]*>.*?</b>", ""), "<[^>]*>", " ")
    name = F.trim(F.regexp_replace(F.split_part(rest, F.lit("("), F.lit(1)), r"\s+", " "))
    rows = cells.select(code.alias("fsa"), name.alias("municipality")).where(F.col("fsa").rlike(r"^[A-Z]\d[A-Z]$") & (F.col("municipality") != ""))
    rows = rows.where(~F.lower("municipality").contains("not assigned") & ~F.col("municipality").contains(":") & (F.length("municipality") <= 60))
    return rows.withColumn("province", lookup(F.substring("fsa", 1, 1), POSTAL_LETTERS))


def annotation_gaps(columns: DataFrame, metadata: DataFrame, domain: str) -> DataFrame:
    return columns.join(metadata.where(F.col("domain") == domain).select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")


def diff_tables(every: DataFrame, registered: list[str]) -> DataFrame:
    """Tables (table_name) that are neither registered nor the framework's own."""
    return every.where(~F.col("table_name").isin(*registered, *SYSTEM_TABLES))


def score_tables(names: DataFrame, request: str) -> DataFrame:
    """names with score: how many of its words, less a final s, are in the request."""
    singular = lambda w: F.regexp_replace(w, "s$", "")
    words = F.transform(F.split(F.lower("table_name"), "_"), singular)
    asked = F.transform(F.split(F.lit(request.lower()), r"\W+"), singular)
    return names.withColumn("score", F.size(F.array_intersect(words, asked))).orderBy(F.desc("score"), "table_name")


#: Annotations under this confidence are listed for someone to look at.
LOW_CONFIDENCE = 0.70


def low_annotations(applied: DataFrame) -> DataFrame:
    return applied.where(F.col("confidence") < LOW_CONFIDENCE)


def apply_annotations(columns: DataFrame, metadata: DataFrame, results: DataFrame, force: bool = False, failed: DataFrame | None = None) -> DataFrame:
    """(table_name, column_name, description, confidence): what is there stays unless forced, then results (300 characters at most), else the name at 0.3.

    failed: tables (table_name) whose annotation failed as a whole; they get nothing, so that they are asked for again.
    """
    keys = ["table_name", "column_name"]
    if failed is not None:
        gone = failed.select("table_name").distinct()
        results = results.join(gone, "table_name", "left_anti")
        columns = columns.join(gone, "table_name", "left_anti").unionByName(columns.join(metadata.select(*keys), keys, "left_semi").join(gone, "table_name", "left_semi"))
    old = metadata.select(*keys, F.col("description").alias("_old"), F.col("confidence").alias("_old_c"))
    new = results.select(*keys, F.substring("description", 1, 300).alias("_new"), F.col("confidence").alias("_new_c"))
    both = columns.join(old, keys, "left").join(new, keys, "left")
    first, second = ("_new", "_old") if force else ("_old", "_new")
    return both.select(*keys, F.coalesce(first, second, F.replace("column_name", F.lit("_"), F.lit(" "))).alias("description"), F.coalesce(f"{first}_c", f"{second}_c", F.lit(0.3)).alias("confidence"))
