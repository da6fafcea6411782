"""Lookups against tables, summaries and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import additive_score
from ..functions.missing import filled, is_blank
from ..functions.text import extract_json, geocode_key


def fsa_of(postal: str | Column) -> Column:
    """The first three characters of a postal code, upper-cased, without spaces."""
    c = F.col(postal) if isinstance(postal, str) else postal
    return F.substring(F.upper(F.regexp_replace(c, r"\s", "")), 1, 3)


def fsa_lookup(df: DataFrame, fsa_map: DataFrame) -> DataFrame:
    """df with fsa_municipality, fsa_confidence (0.95, or 0.0 for an unknown code) and unknown_fsa; of several the least name."""
    known = fsa_map.groupBy("fsa").agg(F.min("normalized_municipality").alias("fsa_municipality"))
    out = df.withColumn("fsa", fsa_of("postal_code")).join(known, "fsa", "left")
    given = ~is_blank("postal_code")
    return out.withColumn("fsa_confidence", F.when(given, F.when(F.col("fsa_municipality").isNotNull(), 0.95).otherwise(0.0))).withColumn("unknown_fsa", given & F.col("fsa_municipality").isNull())


def boundary_lookup(df: DataFrame, fsa_map: DataFrame, country: str = "CA") -> DataFrame:
    """df (fsa, state_province, year) with the municipality of its code and province that is valid for the whole year, the earliest valid one."""
    valid = (F.col("m.valid_from") <= F.make_date("d.year", F.lit(1), F.lit(1))) & (F.col("m.valid_to").isNull() | (F.col("m.valid_to") >= F.make_date("d.year", F.lit(12), F.lit(31))))
    on = (F.col("d.fsa") == F.col("m.fsa")) & (F.col("d.state_province") == F.col("m.province")) & (F.col("m.country") == country) & valid
    hits = df.alias("d").join(fsa_map.alias("m"), on).groupBy("d.id").agg(F.min(F.struct("m.valid_from", "m.normalized_municipality")).alias("b"))
    return df.join(hits.select("id", F.col("b.normalized_municipality").alias("boundary_municipality")), "id", "left")


def city_lookup(df: DataFrame, city_map: DataFrame) -> DataFrame:
    """df with the most confident municipality of its city and province; ties by name."""
    best = city_map.groupBy("city", "province").agg(F.min(F.struct(-F.col("confidence_score"), F.col("municipality"))).alias("b"))
    best = best.select("city", F.col("province").alias("state_province"), F.col("b.municipality").alias("city_municipality"), (-F.col("b.col1")).alias("city_confidence"))
    return df.join(best, ["city", "state_province"], "left")


def null_safe_match(df: DataFrame, other: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """(id, matched_id) for rows of df that have an equal row in other, null equal to null: the least id but its own.

    Each key of ``other`` is brought down to its two least ids first, so equal rows don't make pairs.
    """
    keys = [f"_k{i}" for i in range(len(columns))]
    keyed = lambda d: d.select(F.col(id_column).alias("id"), *[F.col(c).alias(k) for c, k in zip(columns, keys, strict=True)])
    on = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    least = keyed(other).groupBy(*keys).agg(F.min("id").alias("one"))
    more = keyed(other).alias("o").join(least.alias("l"), on("o", "l")).where("o.id > l.one").groupBy(*[F.col(f"o.{k}").alias(k) for k in keys]).agg(F.min("o.id").alias("two"))
    both = least.alias("l").join(more.alias("m"), on("l", "m"), "left").select(*[f"l.{k}" for k in keys], "one", "two")
    found = keyed(df).alias("a").join(both.alias("b"), on("a", "b"))
    return found.select("a.id", F.when(F.col("a.id") == F.col("b.one"), F.col("b.two")).otherwise(F.col("b.one")).alias("matched_id")).where("matched_id IS NOT NULL")


def geocode_join(df: DataFrame, geocodes: DataFrame, now: Column, ttl_days: int = 30, few: bool = False) -> DataFrame:
    """df with lat, lon and geocode_confidence of the row for its key that isn't older than the limit, the newest: 0.90 if the
    city is in its display name, else 0.70; 0.0 without a row; null where street and postal code are both blank. ``few`` rows, as the caller knows, go to the geocodes
    by a broadcast."""
    key = geocode_key("address", "city", "postal_code", "country", F.lit("ca"))
    live = geocodes.where(F.col("fetched_at") > now - F.make_dt_interval(F.lit(ttl_days)))
    if few:
        live = live.join(F.broadcast(df.select(key.alias("query_hash")).distinct()), "query_hash", "left_semi")
    live = live.groupBy("query_hash").agg(F.max(F.struct("fetched_at", "display_name", "lat", "lon")).alias("g")).select("query_hash", "g.lat", "g.lon", "g.display_name")
    out = df.withColumn("query_hash", key).join(F.broadcast(live) if few else live, "query_hash", "left")
    asked = ~(is_blank("address") & is_blank("postal_code"))
    inside = F.instr(F.lower("display_name"), F.lower(F.coalesce("city", F.lit("")))) > 0
    sure = F.when(F.col("display_name").isNull(), 0.0).when(inside & ~is_blank("city"), 0.90).otherwise(0.70)
    return out.select(*df.columns, *[F.when(asked, F.col(c)).alias(c) for c in ("lat", "lon")], F.when(asked, sure).alias("geocode_confidence"))


def resolve_municipality(df: DataFrame) -> DataFrame:
    """The first of cache, boundary and geocode that gives one, with its source and confidence; else for review.
    df: fsa_municipality, boundary_municipality, geocode_confidence, municipality, address.

    A boundary scores by what agrees with it (``additive_score``); under 0.60 without a municipality given to compare it
    with, it is not believed but escalated.
    """
    upstream = filled(F.trim("municipality"))
    agrees = F.lower(upstream) == F.lower(F.col("boundary_municipality"))
    score = additive_score(F.col("fsa_municipality").eqNullSafe(F.col("boundary_municipality")), F.col("boundary_municipality").isNotNull(), F.coalesce(agrees, F.lit(False)), ~is_blank("address"), F.coalesce(~agrees, F.lit(False)))["score"]
    unsure = (score < 0.60) & upstream.isNull()
    sources = {"cache": F.col("fsa_municipality").isNotNull(), "boundary": F.col("boundary_municipality").isNotNull() & ~unsure, "escalate": F.col("boundary_municipality").isNotNull(), "geocode": F.col("geocode_confidence") >= 0.90}
    source = F.coalesce(*[F.when(c, n) for n, c in sources.items()], F.lit("review"))
    values = {"cache": (F.col("fsa_municipality"), F.lit(0.95)), "boundary": (F.col("boundary_municipality"), score), "escalate": (F.lit(None).cast("string"), score), "geocode": (F.col("city"), F.col("geocode_confidence"))}
    value = F.coalesce(*[F.when(source == n, v) for n, (v, _) in values.items()], F.when(source != "escalate", filled("municipality")))
    sure = F.coalesce(*[F.when(source == n, c) for n, (_, c) in values.items()], F.lit(0.0))
    return df.withColumns({"resolved_municipality": value, "resolved_by": source, "resolved_confidence": sure})


def run_report(df: DataFrame) -> DataFrame:
    """One row for each route: records, those with errors, audit entries, and the share of all."""
    by = df.groupBy("route").agg(F.count("*").alias("records"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("audit_entries").alias("audit_entries"))
    total = by.agg(F.sum("records").alias("all_records"))
    return by.join(F.broadcast(total)).select("route", "records", "errors", "audit_entries", F.round(F.col("records") / F.col("all_records"), 4).alias("share"))


def run_summary(df: DataFrame) -> DataFrame:
    """One row: a run in words, from records with route and error."""
    by = df.groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    one = by.agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.coalesce(F.sum(F.when(F.col("route") != "done", F.col("n"))), F.lit(0)).alias("flagged"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "route", "n"))), ", ").alias("routes"))
    return one.select(F.format_string("Cleaned %d/%d records. Routes: %s. %d flagged. %d errors.", F.col("n") - F.col("errors"), "n", "routes", "flagged", "errors").alias("summary"))


def flag_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("flag_type", "severity").agg(F.count("*").alias("n"), F.count_if(F.col("resolved_at").isNull()).alias("unresolved"))


def score_cases(scores: DataFrame) -> DataFrame:
    """scores with overall (mean of three, a missing dimension is 0.5) and verdict."""
    overall = sum((F.coalesce(c, F.lit(0.5)) for c in ("format", "instruction_following")), F.coalesce("correctness", F.lit(0.5))) / F.lit(3.0)
    return scores.withColumn("overall", overall).withColumn("verdict", F.when(F.col("overall") >= 0.8, "pass").when(F.col("overall") >= 0.5, "partial").otherwise("fail"))


DIMENSIONS = ("correctness", "format", "instruction_following")
_JUDGED = "struct<dimensions: struct<correctness: double, format: double, instruction_following: double>, overall_verdict: string, judge_reasoning: string, criteria_results: array<struct<criterion: string, pass: boolean, score: double, reason: string>>>"


def score_judgements(answers: DataFrame) -> DataFrame:
    """answers (raw, criteria, error) with the three scores, overall, verdict, criteria_results and judge_error, from a judge's free text.

    A missing score is 0.5. The verdict is the judge's own, else by the mean. A judge that gives no results for the criteria has
    them inferred from the mean. A text without JSON, no text, or an error: all scores 0.5, partial, no results, and judge_error.
    """
    told = F.from_json(extract_json("raw"), _JUDGED)
    out = answers.withColumn("_j", told).withColumn("judge_error", F.coalesce(F.col("error"), F.when(F.col("raw").isNull(), "Judge not run").when(F.col("_j").isNull(), F.concat(F.lit("Parse failed. Raw: "), F.substring("raw", 1, 200)))))
    fine = F.col("judge_error").isNull()
    out = out.withColumns({d: F.when(fine, F.round(F.coalesce(F.col(f"_j.dimensions.{d}"), F.lit(0.5)), 3)).otherwise(0.5) for d in DIMENSIONS})
    exact = sum((F.coalesce(F.col(f"_j.dimensions.{d}"), F.lit(0.5)) for d in DIMENSIONS[1:]), F.coalesce(F.col(f"_j.dimensions.{DIMENSIONS[0]}"), F.lit(0.5))) / F.lit(3.0)
    mean = F.when(fine, exact).otherwise(0.5)
    by_mean = F.when(mean >= 0.8, "pass").when(mean >= 0.5, "partial").otherwise("fail")
    inferred = F.transform("criteria", lambda c: F.struct(c.alias("criterion"), (mean >= 0.5).alias("pass"), mean.alias("score"), F.lit("Inferred from dimension scores").alias("reason")))
    given = F.col("_j.criteria_results")
    none = F.array().cast("array<struct<criterion: string, pass: boolean, score: double, reason: string>>")
    results = F.when(~fine, none).when(F.size(given) > 0, given).otherwise(F.coalesce(inferred, none))
    return out.withColumns({"overall": F.round(mean, 3), "verdict": F.when(fine, F.coalesce(F.col("_j.overall_verdict"), by_mean)).otherwise("partial"), "criteria_results": results}).drop("_j")


def verdict_counts(scored: DataFrame) -> DataFrame:
    """(verdict, n): how often each verdict was given, zero too."""
    one = scored.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "partial", "fail")])
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in ("pass", "partial", "fail")])).alias("x")).select("x.*")


def eval_summary(scores: DataFrame) -> DataFrame:
    """(dimension, mean, least, most, n) over judged cases, to three places."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("v")) for d in ("correctness", "format", "instruction_following")])).alias("x"))
    return long.groupBy(F.col("x.dimension").alias("dimension")).agg(*[F.round(f("x.v"), 3).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"))], F.count("x.v").alias("n"))


def query_outcomes(events: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """Successes, failures and last use by domain, gap and template; added to what ``memory`` holds."""
    keys = ["domain", "gap_type", "query_template"]
    new = events.groupBy(*keys).agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"), F.max("ts").alias("last_used_at"))
    if memory is None:
        return new
    return memory.select(new.columns).unionByName(new).groupBy(*keys).agg(F.sum("success_count").alias("success_count"), F.sum("failure_count").alias("failure_count"), F.max("last_used_at").alias("last_used_at"))


#: Functions clamp(t + shift) to [low, high], in the order of ``at``, as one.
FOLD = """aggregate(array_sort(collect_list(named_struct('at', at, 'f', f))), named_struct('shift', 0D, 'low', -1000D, 'high', 1000D), (a, x) -> named_struct(
    'shift', a.shift + x.f.shift, 'low', greatest(x.f.low, least(x.f.high, a.low + x.f.shift)), 'high', greatest(x.f.low, least(x.f.high, a.high + x.f.shift))))"""


def trust_steps(events: DataFrame, order: list[str]) -> DataFrame:
    """(domain, url_host, shift, low, high): what all outcomes of a host do to its score t, as one function clamp(t + shift) to [low, high].

    A success adds 0.02, a failure takes 0.01, and each step is kept in [0, 1]. Such functions compose to one of their kind:
    minutes fold their events in order, days their minutes, hosts their days, so no task sees a host's whole history.
    """
    step = F.when(F.col("success"), 0.02).otherwise(-0.01)
    one = F.struct(step.alias("shift"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    parts = events.select("domain", "url_host", F.date_trunc("minute", "ts").alias("minute"), F.struct(*order).alias("at"), one.alias("f"))
    minutes = parts.groupBy("domain", "url_host", F.col("minute").alias("m")).agg(F.expr(FOLD).alias("f"))
    days = minutes.select("domain", "url_host", F.to_date("m").alias("d"), F.col("m").alias("at"), "f").groupBy("domain", "url_host", "d").agg(F.expr(FOLD).alias("f"))
    whole = days.select("domain", "url_host", F.col("d").alias("at"), "f").groupBy("domain", "url_host").agg(F.expr(FOLD).alias("f"))
    return whole.select("domain", "url_host", "f.shift", "f.low", "f.high")


def trusted(score: str = "score") -> Column:
    """A score after the steps of its row."""
    return F.least(F.greatest(F.col(score) + F.col("shift"), F.col("low")), F.col("high"))


def source_trust(events: DataFrame, order: list[str]) -> DataFrame:
    """(domain, url_host, trust_score): from 0.5 on by ``trust_steps``."""
    return trust_steps(events, order).withColumn("score", F.lit(0.5)).select("domain", "url_host", F.round(trusted(), 6).alias("trust_score"))


def cache_stats(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: lookups, hits, misses and the cache's size."""
    got = keys.join(cache.select("lookup_key", F.lit(True).alias("hit")), "lookup_key", "left")
    counts = got.agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    return counts.join(F.broadcast(cache.agg(F.count("*").alias("size"))))


def top_queries(memory: DataFrame, k: int = 3) -> DataFrame:
    """The k best templates of each domain and gap by success rate (none tried last), successes, text."""
    tried = F.col("success_count") + F.col("failure_count")
    rate = F.when(tried > 0, F.col("success_count") / tried)
    rank = F.row_number().over(Window.partitionBy("domain", "gap_type").orderBy(F.desc_nulls_last("success_rate"), F.desc("success_count"), "query_template"))
    return memory.withColumn("success_rate", rate).withColumn("rank", rank).where(F.col("rank") <= k).select("domain", "gap_type", "rank", "query_template", "success_count", F.round("success_rate", 6).alias("success_rate"))


def with_fallback(ranked: DataFrame, wanted: DataFrame, common: str = "_common") -> DataFrame:
    """Ranked templates for wanted (domain, gap_type); where a domain has none, those of the common domain."""
    own = wanted.join(ranked, ["domain", "gap_type"])
    shared = ranked.where(F.col("domain") == common).drop("domain")
    none = wanted.join(ranked.select("domain", "gap_type").distinct(), ["domain", "gap_type"], "left_anti")
    return own.unionByName(none.join(shared, "gap_type").select(own.columns))


def budget_gate(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """df with granted: true for the first n rows by ``order``."""
    first = df.orderBy(*order).limit(n).select("id", F.lit(True).alias("granted"))
    return df.join(first, "id", "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def cap_queries(df: DataFrame, per_record: int = 3, per_gap: int = 2) -> DataFrame:
    """df (id, gap_pos, rank, ...) with at most per_gap templates of a gap, then per_record of a record, in order of gap and rank."""
    order = F.row_number().over(Window.partitionBy("id").orderBy("gap_pos", "rank"))
    return df.where(F.col("rank") <= per_gap).withColumn("query_no", order).where(F.col("query_no") <= per_record)
