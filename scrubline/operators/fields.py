"""Cleaning of single fields by their type: a map, a pattern, learned corrections, and what is left for resolution."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How sure a resolution must be to be applied, and to be learned.
APPLY, LEARN = 0.70, 0.90


@dataclass(frozen=True)
class FieldRule:
    """canonical: lower-cased spelling -> value; valid: patterns of good values; reject: patterns that need resolution."""

    canonical: dict[str, str] = field(default_factory=dict)
    valid: tuple[str, ...] = ()
    reject: tuple[str, ...] = ()


# What names of columns say of their type, if nothing else does.
NAMED = {"postal_code": r"^(postal|zip)|postcode", "gender": r"^(gender|sex)$", "country": r"^country", "city": r"^city$", "address": r"address"}


def field_types(columns: list[str], overrides: dict[str, str] | None = None, sensitive: set[str] = frozenset(), metadata: dict[str, str] | None = None) -> dict[str, str]:
    """column -> type, "sensitive" for those to leave alone: an override counts first, then sensitivity, metadata, and the name."""
    out = {}
    for c in columns:
        named = next((t for t, p in NAMED.items() if re.search(p, c)), None)
        kind = (overrides or {}).get(c) or ("sensitive" if c in sensitive else None) or (metadata or {}).get(c) or named
        if kind:
            out[c] = kind
    return out


def _outcome(rules: dict[str, FieldRule]) -> Column:
    """struct(value, outcome, confidence) by the type's rule; learned corrections come after patterns."""
    raw, key = F.col("original"), F.lower(F.trim("original"))
    cases = [F.when(F.col("field_type") == "sensitive", _said(None, "skipped: sensitive field"))]
    for kind, rule in rules.items():
        here = F.col("field_type") == kind
        if rule.canonical:
            mapped = F.element_at(F.create_map(*[F.lit(x) for kv in rule.canonical.items() for x in kv]), F.coalesce(key, F.lit("")))
            cases.append(F.when(here & mapped.isNotNull(), F.when(mapped == raw, _said(raw, "valid", 1.0)).otherwise(_said(mapped, "mapped", 1.0))))
        for p in rule.valid:
            cases.append(F.when(here & raw.rlike(p), _said(raw, "valid", 1.0)))
        for p in rule.reject:
            cases.append(F.when(here & raw.rlike(p), _said(raw, "open")))
    cases.append(F.when(F.col("learned").isNotNull(), _said(F.col("learned"), "learned", F.col("sure"))))
    return F.coalesce(*cases, _said(raw, "open"))


def _said(value: Column | None, outcome: str, sure: Column | float | None = None) -> Column:
    sure = sure if isinstance(sure, Column) else F.lit(sure)
    value = F.lit(None) if value is None else value
    return F.struct(value.cast("string").alias("value"), F.lit(outcome).alias("outcome"), sure.cast("double").alias("confidence"))


def clean_fields(df: DataFrame, types: dict[str, str], rules: dict[str, FieldRule], learned: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """(id, field, field_type, original, value, outcome, confidence) of each value of a typed column that isn't blank.

    In order: the map, good patterns, rejecting patterns, learned corrections (field_type, raw, corrected, confidence, enabled).
    What is open takes its resolution (id, field, corrected, confidence) if that is sure enough to apply. Values of
    sensitive columns are never shown.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(t).alias("field_type"), F.lit(None).cast("string").alias("original") if t == "sensitive" else F.col(c).cast("string").alias("original"), (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias("given")) for c, t in types.items()])
    long = df.select("id", F.explode(cells).alias("x")).select("id", "x.*").where("given").drop("given")
    known = learned.where("enabled").groupBy("field_type", F.lower("raw").alias("key")).agg(F.max_by("corrected", "confidence").alias("learned"), F.max("confidence").alias("sure"))
    out = long.withColumn("key", F.lower(F.trim("original"))).join(known, ["field_type", "key"], "left").withColumn("x", _outcome(rules))
    out = out.select("id", "field", "field_type", "original", "x.value", "x.outcome", "x.confidence")
    if resolutions is None:
        return out
    told = resolutions.select("id", "field", F.col("corrected").alias("_new"), F.col("confidence").alias("_sure"))
    both = out.join(told, ["id", "field"], "left").withColumn("_open", (F.col("outcome") == "open") & F.col("_sure").isNotNull())
    apply = F.col("_open") & (F.col("_sure") >= APPLY)
    outcome = F.when(apply, F.when(F.col("_sure") >= LEARN, "resolved").otherwise("needs_review")).when(F.col("_open"), "unresolvable").otherwise(F.col("outcome"))
    return both.select("id", "field", "field_type", "original", F.when(apply, F.col("_new")).otherwise(F.col("value")).alias("value"), outcome.alias("outcome"), F.when(F.col("_open"), F.col("_sure")).otherwise(F.col("confidence")).alias("confidence"))


def newly_learned(cleaned: DataFrame) -> DataFrame:
    """(field_type, raw, corrected, confidence, times_seen) of resolutions that are sure enough to learn."""
    sure = cleaned.where(F.col("outcome") == "resolved")
    return sure.groupBy("field_type", F.lower(F.trim("original")).alias("raw"), F.col("value").alias("corrected")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("times_seen"))
