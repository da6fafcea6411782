"""Queries of profiles, rule gaps and query patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import patterns
from .registry import Registry

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

PROFILED = ["name", "city", "postal_code", "municipality", "country", "phone", "email"]
RULES = [
    patterns.GapRule("malformed", "postal_code", pattern=r"^[A-Za-z]\d[A-Za-z] ?\d[A-Za-z]\d$", when="CA"),
    patterns.GapRule("out_of_range", "age", low=1, high=120),
    patterns.GapRule("mismatch", "city", other="municipality"),
]
NOW = "date'2024-02-05'"


@reg.add(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (trim({c}) = '') AS blanks, count(*) AS records, CASE WHEN count(*) FILTER (coalesce(trim({c}), '') = '') > 0 THEN 'missing:{c}' END AS proposed_gap FROM listings" for c in PROFILED),
    "listings",
)
def domain_profile(t) -> DataFrame:
    return patterns.domain_profile(t.listings, PROFILED)


@reg.add(
    r""", g AS (SELECT id, [CASE WHEN trim(postal_code) <> '' AND lower(country) = 'ca' AND NOT regexp_matches(postal_code, '^[A-Za-z]\d[A-Za-z] ?\d[A-Za-z]\d$') THEN 'malformed:postal_code|ca' END, CASE WHEN age NOT BETWEEN 1 AND 120 THEN 'out_of_range:age' END,
 CASE WHEN trim(city) <> '' AND city IS DISTINCT FROM municipality THEN 'mismatch:city+municipality' END] AS gs FROM listings) SELECT id, array_to_string([x FOR x IN gs IF x IS NOT NULL], ',') AS gaps FROM g""",
    "listings",
)
def rule_gaps(t) -> DataFrame:
    return t.listings.select("id", F.array_join(patterns.rule_gaps(RULES, "country"), ",").alias("gaps"))


@reg.add(
    ", g AS (SELECT id, 'missing:city' || CASE WHEN country IS NULL THEN '' ELSE '|' || lower(country) END AS gap FROM listings) SELECT id, gap, CASE WHEN gap = 'missing:city|ca' THEN 'ask the post' ELSE 'ask anyone' END AS value FROM g",
    "listings",
)
def most_specific_gap(t) -> DataFrame:
    gaps = t.listings.select("id", F.concat(F.lit("missing:city"), F.coalesce(F.concat(F.lit("|"), F.lower("country")), F.lit(""))).alias("gap"))
    known = t.listings.agg(F.count_if(F.col("country") == "CA").alias("n")).where("n > 0").select(F.explode(F.array(F.struct(F.lit("missing:city|ca").alias("gap"), F.lit("ask the post").alias("value")), F.struct(F.lit("missing:city").alias("gap"), F.lit("ask anyone").alias("value")))).alias("x")).select("x.*")
    return patterns.most_specific(gaps, known)


KEYS = ["domain", "gap_type", "query_template"]
K = ", ".join(KEYS)


@reg.add(
    f""", r AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ts DESC, event_id DESC) AS r FROM query_outcomes), a AS (SELECT {K}, count(*) AS uses, count(DISTINCT url_host) AS sources, avg(success::INT) AS rate, avg(success::INT) FILTER (r <= 10) AS recent, max(ts) AS last FROM r GROUP BY ALL)
SELECT {K}, uses, sources, round(rate * pow(0.95, date_diff('day', last::DATE, {NOW})), 6) AS strength, CASE WHEN rate - recent > 0.15 THEN 'demoted' WHEN uses >= 5 AND sources >= 3 AND rate >= 0.75 THEN 'promoted' ELSE 'candidate' END AS state FROM a""",
    "query_outcomes",
)
def promoted_patterns(t) -> DataFrame:
    out = patterns.promoted(t.query_outcomes.withColumn("source", F.col("url_host")), KEYS, F.expr(NOW))
    return out.select(*KEYS, "uses", "sources", F.round("strength", 6).alias("strength"), "state")


@reg.add(
    f""", e AS (SELECT {K}, ts::DATE AS day, ts, event_id, url_host, success::INT AS ok, count(*) OVER w AS uses, sum(success::INT) OVER w AS won, list(success::INT) OVER (PARTITION BY {K} ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ten,
  row_number() OVER (PARTITION BY {K}, url_host ORDER BY ts, event_id) = 1 AS first_use FROM query_outcomes WINDOW w AS (PARTITION BY {K} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, sum(first_use::INT) OVER (PARTITION BY {K} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sources, row_number() OVER (PARTITION BY {K}, day ORDER BY ts DESC, event_id DESC) AS back FROM e),
d AS (SELECT *, won / uses AS rate, list_sum(ten) / len(ten) AS recent FROM s WHERE back = 1),
c AS (SELECT *, CASE WHEN uses >= 5 AND sources >= 3 AND rate >= 0.75 AND recent >= 0.75 THEN 2 ELSE 0 END + CASE WHEN rate - recent > 0.15 THEN 1 ELSE 0 END AS code FROM d),
f AS (SELECT *, list_reduce(list(code) OVER (PARTITION BY {K} ORDER BY day ROWS UNBOUNDED PRECEDING), lambda s, x: CASE WHEN s = 1 THEN CASE WHEN x % 2 = 1 THEN 2 ELSE 1 END WHEN x >= 2 THEN 1 ELSE s END, 0) AS st FROM c)
SELECT {K}, day, uses, ['candidate', 'promoted', 'demoted'][st + 1] AS state FROM f""",
    "query_outcomes",
)
def pattern_states(t) -> DataFrame:
    return patterns.pattern_states(t.query_outcomes.withColumn("source", F.col("url_host")), KEYS, "event_id")


@reg.add(f"SELECT {K}, count(*) AS uses, round(avg(success::INT), 6) AS hit_rate, date_diff('day', max(ts)::DATE, {NOW}) > 7 AS idle FROM query_outcomes GROUP BY ALL", "query_outcomes")
def pattern_health(t) -> DataFrame:
    return patterns.pattern_health(t.query_outcomes, KEYS, F.expr(NOW))


@reg.add("SELECT id, greatest(municipality_confidence, least((id % 100) / 100.0::DOUBLE, 0.84)) AS confidence FROM listings WHERE municipality_confidence IS NOT NULL", "listings")
def hinted_confidence(t) -> DataFrame:
    return t.listings.where("municipality_confidence IS NOT NULL").select("id", patterns.hinted_confidence(F.col("municipality_confidence"), F.expr("(id % 100) / 100.0D"), 0.84).alias("confidence"))


@reg.add("SELECT test_case_id, correctness, lag(correctness) OVER w AS before, correctness - lag(correctness) OVER w AS change FROM judge_scores WINDOW w AS (PARTITION BY test_case_id % 50 ORDER BY test_case_id)", "judge_scores")
def confidence_trend(t) -> DataFrame:
    history = t.judge_scores.withColumn("series", F.col("test_case_id") % 50)
    return patterns.confidence_trend(history, "series", "test_case_id", "correctness").select("test_case_id", "correctness", "before", "change")
