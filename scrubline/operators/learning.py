"""Spelling, learned corrections, country matching and enrichment from search results."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.missing import is_blank
from ..functions.places import COUNTRY_ALIASES, country_code
from ..functions.text import sides_of, team_name, title_case
from .tables import insert_ignore


#: Overrides up to which they are broadcast; more are joined by a shuffle.
OVERRIDES = 200_000


def spell_override(df: DataFrame, column: str, overrides: DataFrame) -> DataFrame:
    """df with ``column`` corrected where its whole text, any case, is in overrides (wrong, fixed); title case if it began with a capital."""
    table = overrides.groupBy(F.lower("wrong").alias("_wrong")).agg(F.min("fixed").alias("_fixed"))
    if overrides.limit(OVERRIDES + 1).count() <= OVERRIDES:
        table = F.broadcast(table)
    out = df.join(table, F.lower(df[column]) == F.col("_wrong"), "left")
    first = F.substring(column, 1, 1)
    fixed = F.when((first == F.upper(first)) & (first != F.lower(first)), title_case("_fixed")).otherwise(F.col("_fixed"))
    return out.withColumn(column, F.coalesce(fixed, F.col(column))).drop("_wrong", "_fixed")


def build_dictionary(docs: DataFrame, column: str = "text", at_least: int = 5) -> DataFrame:
    """(term, n): runs of a-z that occur often enough."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"([a-z]+)"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def _shortened(c: Column) -> Column:
    """The text and all texts with one character taken out."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), c.substr(i + 1, F.length(c))))))


def spell_dictionary(values: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """(value, suggestion, distance): for each distinct text the closest term at one edit (a swap of neighbours counts
    one), the most frequent, then the first; texts that are terms have none. At 1 - 0.1 a further edit isn't sure enough."""
    values = values.select(F.lower(column).alias("value")).where(F.length("value") > 1).distinct()
    values = values.join(terms.select(F.col("term").alias("value")), "value", "left_anti")
    a = values.select("value", F.explode(_shortened(F.col("value"))).alias("key"))
    b = terms.select("term", "n", F.explode(_shortened(F.col("term"))).alias("key"))
    pairs = a.join(b, "key").select("value", "term", "n").distinct()
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length("value") - 1, F.lit(1))), lambda i: F.concat(F.substring(F.col("value"), F.lit(1), i - 1), F.col("value").substr(i + 1, F.lit(1)), F.col("value").substr(i, F.lit(1)), F.col("value").substr(i + 2, F.length("value"))) == F.col("term"))
    near = pairs.where((F.levenshtein("value", "term") == 1) | ((F.length("value") == F.length("term")) & swap))
    best = near.groupBy("value").agg(F.min(F.struct(-F.col("n"), F.col("term"))).alias("b"))
    return best.select("value", F.col("b.term").alias("suggestion"), F.lit(1).alias("distance"))


@F.pandas_udf(StringType())
def _closest_country(names: pd.Series) -> pd.Series:
    """The code of the closest known spelling at a ratio of 0.80 or more."""
    found = names.map(lambda n: next(iter(difflib.get_close_matches(n, COUNTRY_ALIASES, n=1, cutoff=0.80)), None))
    return found.map(lambda a: COUNTRY_ALIASES.get(a))


def normalize_country(df: DataFrame, column: str) -> DataFrame:
    """df with country_code (exact spellings) and country_suggestion (the code, or that of the closest spelling, judged
    once for each distinct text)."""
    out = df.withColumn("country_code", country_code(column)).withColumn("_key", F.lower(F.trim(column)))
    misses = out.where(F.col("country_code").isNull() & ~is_blank(column)).select("_key").distinct()
    close = misses.withColumn("_close", _closest_country("_key"))
    return out.join(close, "_key", "left").withColumn("country_suggestion", F.coalesce("country_code", "_close")).drop("_key", "_close")


def propose_corrections(before: DataFrame, after: DataFrame, columns: list[str], max_edits: int = 2) -> DataFrame:
    """(wrong, fixed, n) from texts that changed by few edits between two tables with one row an id."""
    both = before.alias("b").join(after.alias("a"), "id")
    return small_changes(both, [(f"b.{c}", f"a.{c}") for c in columns], max_edits)


def small_changes(df: DataFrame, pairs: list[tuple[str, str]], max_edits: int = 2) -> DataFrame:
    """(wrong, fixed, n) from pairs of columns, before and after: both there, four characters or more, without digits, lower-cased."""
    long = df.select(F.explode(F.array(*[F.struct(F.lower(F.trim(F.col(b))).alias("wrong"), F.lower(F.trim(F.col(a))).alias("fixed")) for b, a in pairs])).alias("x")).select("x.*")
    keep = ~is_blank("wrong") & ~is_blank("fixed") & (F.col("wrong") != F.col("fixed")) & (F.length("wrong") >= 4) & ~F.col("wrong").rlike("[0-9]")
    return long.where(keep).where(F.levenshtein("wrong", "fixed", max_edits) >= 0).groupBy("wrong", "fixed").agg(F.count("*").alias("n"))


def record_learned(corrections: DataFrame, proposals: DataFrame) -> DataFrame:
    """corrections (wrong, fixed, source, confidence) and new proposals as learned at 0.75; what is there wins, then the most frequent proposal."""
    new = proposals.select("wrong", "fixed", F.lit("learned").alias("source"), F.lit(0.75).alias("confidence"), F.concat(F.lpad((1000000000 - F.col("n")).cast("string"), 10, "0"), F.col("fixed")).alias("_order"))
    return insert_ignore(corrections, new, ["wrong"], "_order")


# Municipalities that searches are read for, country patterns in order, and what a place, a company and a dial code look like.
MUNICIPALITIES = (
    "Toronto", "Scarborough", "North York", "Etobicoke", "York", "East York", "Mississauga", "Brampton", "Vaughan", "Markham", "Richmond Hill",
    "Oakville", "Burlington", "Hamilton", "Ajax", "Pickering", "Whitby", "Oshawa", "Barrie", "Kingston", "Ottawa", "London", "Windsor", "Sudbury",
    "Thunder Bay",
)
COUNTRY_MENTIONS = {"CA": r"\bCanada\b", "US": r"\bUnited States\b|\bUSA\b|\bU\.S\.A\b", "GB": r"\bUnited Kingdom\b|\bUK\b|\bGB\b"}
PLACE_WORDS, PLACE_ENDS = "municipality|city|town|village", "is|has"
COMPANY_WORDS = "company|organization|corporation"
DIAL_CODE = r"\+(\d{1,3})\s+(?:country|code|dial)"


def parse_evidence(gap: Column, text: Column) -> Column:
    """struct(field, value, confidence, source_url, snippet) that a search result gives for a gap; null if none.

    Names are read in stretches of letters and spaces. A stretch without an end of the wanted kind has none from any of
    its letters, so it is read once, from its first letter or first place word, and the time is linear in the text.
    """
    stretch = r"(?<![a-zA-Z\s])"
    known = title_case(F.regexp_extract(text, rf"(?i)\b({'|'.join(MUNICIPALITIES)})\b", 1))
    place = title_case(F.trim(F.regexp_extract(text, rf"(?i){stretch}(?>[a-zA-Z\s]*?(?:{PLACE_WORDS})\s+)(?:of\s+)?([A-Z]\s(?=\s+(?:{PLACE_ENDS}))|[A-Z][a-zA-Z\s]+?(?=[.,]|(?<!\s)\s++(?:{PLACE_ENDS})))", 1)))
    place = F.when(F.length(place).between(3, 50), place)
    country = F.coalesce(*[F.when(text.rlike(f"(?i){p}"), c) for c, p in COUNTRY_MENTIONS.items()])
    firm = F.trim(F.regexp_extract(text, rf"(?i){stretch}\s*+([A-Z](?:\s|[a-zA-Z\s]*?[a-zA-Z]))\s++is\s+(?:a|an)\s+(?:{COMPANY_WORDS})", 1))
    dial = F.regexp_extract(text, f"(?i){DIAL_CODE}", 1)
    cases = {"postal_unresolved": ("municipality", known, 0.75), "municipality_ambiguous": ("municipality", place, 0.70), "unknown_country": ("country", country, 0.65), "unknown_email_domain": ("email_org", firm, 0.60), "unknown_phone_format": ("phone_country_code", F.when(dial != "", F.concat(F.lit("+"), dial)), 0.60)}
    url = F.nullif(F.regexp_extract(text, r"(https?://\S+)", 1), F.lit(""))
    return F.coalesce(*[F.when((gap == g) & (F.coalesce(v, F.lit("")) != ""), F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(c).alias("confidence"), url.alias("source_url"), F.substring(text, 1, 200).alias("snippet"))) for g, (f, v, c) in cases.items()])


def read_evidence(results: DataFrame, gap: str = "gap", text: str = "text") -> DataFrame:
    """results with ``e``, the evidence of each that gives some; the parser runs once for each row."""
    return results.select("*", F.explode(F.array_compact(F.array(parse_evidence(F.col(gap), F.col(text))))).alias("e"))


def normalize_events(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with ``column`` as 'A vs B' in canonical names, by aliases (alias, canonical) before the built-in ones; of several the least."""
    table = F.broadcast(aliases.groupBy(F.lower(F.trim("alias")).alias("_alias")).agg(F.min("canonical").alias("_name"))) if aliases.limit(OVERRIDES + 1).count() <= OVERRIDES else aliases.groupBy(F.lower(F.trim("alias")).alias("_alias")).agg(F.min("canonical").alias("_name"))
    out = df.withColumns({f"_{side}": part for side, part in zip("lr", sides_of(column), strict=True)})
    for side in "lr":
        out = out.join(table, F.lower(F.trim(f"_{side}")) == F.col("_alias"), "left").withColumn(f"_{side}", F.when(F.col(f"_{side}") != "", F.coalesce("_name", team_name(F.col(f"_{side}"))))).drop("_alias", "_name")
    new = F.concat("_l", F.lit(" vs "), "_r")
    return out.withColumn(column, F.when(F.lower(new) != F.lower(F.col(column)), new).otherwise(F.col(column))).drop("_l", "_r")


def plan_lookup(signatures: DataFrame, plans: DataFrame, now: Column, known: list[str]) -> DataFrame:
    """signatures (id, signature) with the steps of the plan that hasn't expired, known ones in the known order; of several
    plans of a signature that which expires last, then the greatest."""
    live = plans.where(F.col("expires_at") > now).groupBy("signature").agg(F.max(F.struct("expires_at", "steps")).alias("p")).select("signature", "p.steps")
    order = F.array(*[F.lit(k) for k in known])
    return signatures.join(live, "signature", "left").select("id", "signature", F.array_join(F.filter(order, lambda k: F.array_contains("steps", k)), ",").alias("plan"))


def municipality_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, old_municipality, new_municipality) where they differ, null counting as a value."""
    both = before.select("id", F.col("municipality").alias("old_municipality")).join(after.select("id", F.col("municipality").alias("new_municipality")), "id")
    return both.where(~F.col("old_municipality").eqNullSafe(F.col("new_municipality")))


def window_top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
