"""Profiles of a domain, qualified gaps, and the life of learned query patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import array_of, build_gap
from ..functions.missing import is_blank


def domain_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, blanks, records, proposed_gap): one pass over all columns; a gap is proposed where any value is missing."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    blanks = [F.count_if(is_blank(c) & F.col(c).isNotNull()).alias(f"b{i}") for i, c in enumerate(columns)]
    one = df.agg(F.count("*").alias("records"), *nulls, *blanks)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col(f"b{i}").alias("blanks")) for i, c in enumerate(columns)]))
    out = one.select("records", rows.alias("r")).select("r.*", "records")
    return out.withColumn("proposed_gap", F.when(F.col("nulls") + F.col("blanks") > 0, F.concat(F.lit("missing:"), "column")))


@dataclass(frozen=True)
class GapRule:
    """malformed: the pattern fails; out_of_range: not within low and high; mismatch: two fields differ. when: value of the discriminator, or any."""

    verb: str
    field: str
    pattern: str = ""
    low: float = 0.0
    high: float = 0.0
    other: str = ""
    when: str | None = None


def rule_gaps(rules: list[GapRule], discriminator: str) -> Column:
    """Gaps by rules whose discriminator fits; blank values raise none, and no rule means no gap."""
    out = []
    for r in rules:
        c = F.col(r.field)
        bad = {"malformed": ~c.cast("string").rlike(r.pattern or "^"), "out_of_range": ~c.cast("double").between(r.low, r.high), "mismatch": ~c.eqNullSafe(F.col(r.other or r.field))}[r.verb]
        fits = F.lit(True) if r.when is None else F.lower(F.col(discriminator)) == r.when.lower()
        gap = build_gap(r.verb, [r.field, r.other] if r.other else r.field, None if r.when is None else F.lit(r.when))
        out.append(F.when(~is_blank(r.field) & fits & bad, gap))
    return F.array_distinct(array_of(*out))


def most_specific(gaps: DataFrame, table: DataFrame) -> DataFrame:
    """gaps (id, gap) with the value of the qualified gap in table (gap, value), else that of the gap without qualifier."""
    own = table.select("gap", F.col("value").alias("_own"))
    plain = table.select(F.col("gap").alias("_plain_gap"), F.col("value").alias("_plain"))
    out = gaps.join(own, "gap", "left").join(plain, F.split_part("gap", F.lit("|"), F.lit(1)) == F.col("_plain_gap"), "left")
    return out.select("id", "gap", F.coalesce("_own", "_plain").alias("value"))


def promoted(uses: DataFrame, key: list[str], now: Column) -> DataFrame:
    """(key, uses, sources, rate, recent_rate, strength, state) of patterns from uses (key, ts, source, success).

    promoted: 5 uses, 3 sources, three in four succeed; demoted: the last ten succeed 0.15 less often than all;
    strength is the rate, less 5 % for each day since the last use.
    """
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("event_id")))
    recent = uses.withColumn("r", last).where("r <= 10").groupBy(*key).agg(F.avg(F.col("success").cast("int")).alias("recent_rate"))
    every = uses.groupBy(*key).agg(F.count("*").alias("uses"), F.count_distinct("source").alias("sources"), F.avg(F.col("success").cast("int")).alias("rate"), F.max("ts").alias("last_used"))
    out = every.join(recent, key)
    state = F.when(F.col("rate") - F.col("recent_rate") > 0.15, "demoted").when((F.col("uses") >= 5) & (F.col("sources") >= 3) & (F.col("rate") >= 0.75), "promoted").otherwise("candidate")
    return out.withColumns({"state": state, "strength": F.col("rate") * F.pow(F.lit(0.95), F.date_diff(now, F.to_date("last_used")))})


def pattern_states(uses: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, day, uses, state): what each pattern is at the end of every day on which it was used; uses: (key, ts, order, source, success).

    A candidate, or one that was demoted, is promoted at 5 uses and 3 sources in all, three in four of them successes and of
    the last ten too; a promoted one is demoted when its last ten succeed 0.15 less often than all. A day is so a function of
    the state, and the days of a pattern are folded in order. Minutes and then days keep their last ten uses only, and a source
    counts on its first day, so no task sees all uses of a pattern.
    """
    day = F.to_date("ts")
    last = lambda c: F.slice(F.reverse(F.array_sort(c)), 1, 10)
    each = uses.select(*key, day.alias("day"), F.date_trunc("minute", "ts").alias("minute"), "source", F.col("success").cast("int").alias("ok"), F.struct("ts", order, F.col("success").cast("int").alias("ok")).alias("u"))
    minutes = each.groupBy(*key, "day", "minute").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"), last(F.collect_list("u")).alias("last"))
    days = minutes.groupBy(*key, "day").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), last(F.flatten(F.collect_list("last"))).alias("last"))
    sources = each.groupBy(*key, "source").agg(F.min("day").alias("day")).groupBy(*key, "day").agg(F.count("*").alias("new_sources"))
    so_far = Window.partitionBy(*key).orderBy("day")
    # each day has a use at least, so ten days have the last ten
    known = days.join(sources, [*key, "day"], "left").withColumns({"uses": F.sum("n").over(so_far), "won": F.sum("ok").over(so_far), "sources": F.sum(F.coalesce("new_sources", F.lit(0))).over(so_far), "ten": last(F.flatten(F.collect_list("last").over(so_far.rowsBetween(-9, 0))))})
    recent = F.aggregate("ten", F.lit(0), lambda s, u: s + u["ok"]) / F.size("ten")
    rate = F.col("won") / F.col("uses")
    up = (F.col("uses") >= 5) & (F.col("sources") >= 3) & (rate >= 0.75) & (recent >= 0.75)
    down = rate - recent > 0.15
    line = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("day", "uses", up.alias("up"), down.alias("down")))).alias("days"))
    step = """aggregate(days, array(named_struct('day', CAST(NULL AS DATE), 'uses', 0L, 'state', 'candidate')), (a, d) -> concat(a, array(named_struct('day', d.day, 'uses', d.uses, 'state',
        CASE WHEN element_at(a, -1).state = 'promoted' THEN IF(d.down, 'demoted', 'promoted') WHEN d.up THEN 'promoted' ELSE element_at(a, -1).state END))))"""
    return line.select(*key, F.explode(F.expr(f"slice({step}, 2, size(days))")).alias("d")).select(*key, "d.*")


def hinted_confidence(confidence: Column, hint: Column, cap: float = 0.84) -> Column:
    """Confidence raised to the hint, at most to the cap, and never lowered."""
    return F.greatest(confidence, F.least(hint, F.lit(cap)))


def confidence_trend(history: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """history with the value before, and the change since."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(at))
    return history.withColumn("before", before).withColumn("change", F.col(value) - F.col("before"))


def pattern_health(uses: DataFrame, key: list[str], now: Column, idle_days: int = 7) -> DataFrame:
    """(key, uses, hit_rate, idle): how patterns do, and which weren't used for long."""
    out = uses.groupBy(*key).agg(F.count("*").alias("uses"), F.avg(F.col("success").cast("int")).alias("hit_rate"), F.max("ts").alias("last"))
    return out.select(*key, "uses", F.round("hit_rate", 6).alias("hit_rate"), (F.date_diff(now, F.to_date("last")) > idle_days).alias("idle"))
