"""Domains and the cleaning pipeline.

Records are cleaned and checked, and triaged. Those for review are looked up, enriched from search results and
triaged again; what is still for review runs the steps of its plan, and then is escalated. Records are linked, and
corrections learned from what changed after the first phase. A phase works on the rows that need it, all at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, text
from ..functions.missing import filled, is_blank_or_na
from ..operators import enrichment, learning, linkage, lookups
from ..operators.numbering import first_by
from ..operators.scratch import discard, written


@dataclass(frozen=True)
class Step:
    name: str
    phase: int
    cost: str
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Domain:
    """A domain's steps and the parameters of its triage (none without required fields) and linkage."""

    name: str
    steps: tuple[Step, ...]
    required: list[str] = field(default_factory=list)
    learnable: tuple[str, ...] = ()
    blocks: list[str] = field(default_factory=list)
    rules: tuple[linkage.Rule, ...] = linkage.RULES

    def ordered(self) -> list[Step]:
        """Steps after those they need, by phase; a missing one or a cycle is an error."""
        by, out, open_ = {s.name: s for s in self.steps}, [], []

        def visit(name: str) -> None:
            if name not in by:
                raise ValueError(f"{self.name}: no step {name}")
            if name in open_:
                raise ValueError(f"{self.name}: cycle through {name}")
            if by[name] not in out:
                open_.append(name)
                for n in by[name].needs:
                    visit(n)
                open_.pop()
                out.append(by[name])

        for s in sorted(self.steps, key=lambda s: s.phase):
            visit(s.name)
        return out


REAL_ESTATE = Domain(
    "real_estate",
    (
        Step("spell_override", 1, "low"),
        Step("standardize_address", 1, "low"),
        Step("fsa_lookup", 2, "medium", ("standardize_address",)),
        Step("geographic_validate", 1, "low", ("standardize_address",)),
        Step("geocode", 2, "high", ("standardize_address",)),
        Step("enrich", 3, "high", ("fsa_lookup",)),
        Step("escalate", 5, "high", ("fsa_lookup",)),
        Step("link", 6, "medium", ("spell_override", "standardize_address")),
    ),
    ["name", "address", "city", "postal_code", "country"],
    ("city", "municipality"),
    ["postal_code"],
)
SPORTS_TICKETING = Domain(
    "sports_ticketing",
    (Step("normalize_event_name", 2, "low"), Step("categorize_product", 2, "low"), Step("link", 6, "low", ("normalize_event_name",))),
    blocks=["event_date"],
    rules=(linkage.Rule("venue_team_date", ("venue_name", "home_team", "event_date"), "fuzzy", 0.85, 0.90),),
)
DOMAINS = {d.name: d for d in (REAL_ESTATE, SPORTS_TICKETING)}

# LIKE pattern of a column name -> role and how sure, first hit counts.
ROLES = {
    "id": ("identifier", 0.99), "%_id": ("foreign_key", 0.95), "name": ("person_name", 0.85), "age": ("integer_measure", 0.95), "city": ("locality", 0.90),
    "address": ("street_address", 0.90), "postal_code": ("postal_code", 0.95), "municipality": ("district", 0.75), "state_province": ("administrative_area", 0.90),
    "country": ("country", 0.95), "phone": ("phone_number", 0.95), "validation_notes": ("free_text", 0.70), "reason": ("free_text", 0.70), "description": ("free_text", 0.70),
    "flag_type": ("categorical_label", 0.80), "severity": ("categorical_label", 0.80), "rule_applied": ("categorical_label", 0.80), "%_at": ("timestamp", 0.95), "%_by": ("actor_label", 0.85),
}


def infer_roles(columns: DataFrame) -> DataFrame:
    """columns (column_name) with inferred_role and role_confidence by name; generic_text at 0.30 otherwise."""
    hits = [(F.col("column_name") == k) if "%" not in k else F.lower("column_name").endswith(k[1:]) for k in ROLES]
    role = F.coalesce(*[F.when(h, r) for h, (r, _) in zip(hits, ROLES.values(), strict=True)], F.lit("generic_text"))
    sure = F.coalesce(*[F.when(h, c) for h, (_, c) in zip(hits, ROLES.values(), strict=True)], F.lit(0.30))
    return columns.withColumns({"inferred_role": role, "role_confidence": sure})


def needs_research() -> Column:
    return is_blank_or_na("municipality") | (F.length(F.coalesce(F.trim("postal_code"), F.lit(""))) < 5)


def apply_resolutions(df: DataFrame, resolutions: DataFrame, fields: list[str]) -> DataFrame:
    """df with non-empty resolved values (by id), resolved_fields that changed, and 0.85 if any was given, else 0.40."""
    both = df.join(resolutions.select("id", *[filled(f).alias(f"_{f}") for f in fields]), "id", "left")
    changed = checks.array_of(*[F.when(F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)), f) for f in fields])
    sure = F.when(F.coalesce(*[f"_{f}" for f in fields]).isNotNull(), 0.85).otherwise(0.40)
    both = both.withColumns({"resolved_fields": changed, "resolution_confidence": sure})
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in df.columns], "resolved_fields", "resolution_confidence")


def record_signature(df: DataFrame, fields: list[str], confidence: str, domain: str, version: int = 1) -> DataFrame:
    """(id, signature): a SHA-256 of which fields are there, the confidence to one place, the route and the sorted gaps (where
    df has these), the domain and a version. Records of one shape have one."""
    present = F.array_sort(checks.array_of(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "", f) for f in fields]))
    more = [F.col("route")] if "route" in df.columns else []
    more += [F.array_sort("gaps").alias("gaps")] if "gaps" in df.columns else []
    shape = F.to_json(F.struct(present.alias("fields"), F.round(confidence, 1).alias("confidence"), *more, F.lit(domain).alias("domain"), F.lit(version).alias("version")))
    return df.select("id", F.sha2(shape, 256).alias("signature"))


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with columns cast; what can't be cast is null, and named in error. No row is lost."""
    casts = {c: F.expr(f"try_cast({c} AS {k})") for c, k in kinds.items()}
    error = F.coalesce(*[F.when(F.col(c).isNotNull() & v.isNull(), F.lit(f"{c} is not a number")) for c, v in casts.items()])
    return df.withColumn("error", error).withColumns(casts)


@dataclass(frozen=True)
class Given:
    """The tables that steps look things up in, the time, and what each expensive step may spend; a step without its table is left out.
    few: what a step gets are rows enough for a broadcast at most."""

    overrides: DataFrame | None = None
    fsa_map: DataFrame | None = None
    templates: DataFrame | None = None
    results: DataFrame | None = None
    geocodes: DataFrame | None = None
    plans: DataFrame | None = None
    resolutions: DataFrame | None = None
    now: str = "2025-01-01 00:00:00"
    budget: int | None = None
    few: bool = False

    def at(self) -> Column:
        return F.lit(self.now).cast("timestamp")


AUDIT = "array<struct<skill: string, field: string, original: string, corrected: string, confidence: double>>"


def audited(df: DataFrame, step: str, column: str, change: Callable[[DataFrame], DataFrame], sure: Column | float = 1.0) -> DataFrame:
    """df after ``change``, with an entry in audit where it changed the column."""
    new = change(df.withColumn("_before", F.col(column)))
    sure = sure if isinstance(sure, Column) else F.lit(sure)
    entry = F.when(~F.col("_before").eqNullSafe(F.col(column)), F.struct(F.lit(step).alias("skill"), F.lit(column).alias("field"), F.col("_before").cast("string").alias("original"), F.col(column).cast("string").alias("corrected"), sure.cast("double").alias("confidence")))
    return new.withColumn("audit", F.concat("audit", checks.array_of(entry))).drop("_before")


def noted(df: DataFrame, step: str, entry: Column, sure: Column | float, of: str | Column = "") -> DataFrame:
    """df with an entry in audit where ``entry`` isn't null."""
    said = F.struct(F.lit(step).alias("skill"), (F.lit(of) if isinstance(of, str) else of).alias("field"), F.lit(None).cast("string").alias("original"), entry.alias("corrected"), (sure if isinstance(sure, Column) else F.lit(sure)).cast("double").alias("confidence"))
    return df.withColumn("audit", F.concat("audit", checks.array_of(F.when(entry.isNotNull(), said))))


def _gaps(df: DataFrame) -> Column:
    """A record's gaps: what is missing, what the lookup left open, and hints if it has some."""
    missing = checks.classify_gaps({"country": None, "postal_code": "country", "municipality": "country"})
    unknown = F.col("unknown_fsa") if "unknown_fsa" in df.columns else F.lit(False)
    return checks.identify_gaps(missing, unknown, F.col("municipality_confidence"), F.col("gap_hints") if "gap_hints" in df.columns else None)


def _fsa_lookup(df: DataFrame, given: Given) -> DataFrame:
    """The municipality of the code where there is none; the lookup's confidence is the municipality's, 0.0 if it failed."""
    kept = df.drop("fsa", "fsa_municipality", "fsa_confidence", "unknown_fsa")
    looked = lookups.fsa_lookup(kept, given.fsa_map)
    sure = F.coalesce("fsa_confidence", "municipality_confidence")
    found = F.when(is_blank_or_na("municipality"), F.coalesce("fsa_municipality", "municipality")).otherwise(F.col("municipality"))
    return looked.withColumns({"municipality": found, "municipality_confidence": sure})


def _geocode(df: DataFrame, given: Given) -> DataFrame:
    out = lookups.geocode_join(df.drop("lat", "lon", "geocode_confidence"), given.geocodes, given.at(), few=given.few)
    return noted(out, "geocode", F.when(F.col("lat").isNotNull(), F.concat_ws(" ", "lat", "lon")), F.col("geocode_confidence"))


def _enrich(df: DataFrame, given: Given) -> enrichment.Enriched:
    out = enrichment.enrich(df.withColumn("gaps", _gaps(df)).drop("evidence"), given.templates, given.results, "real_estate", given.budget)
    return enrichment.Enriched(out.records.withColumn("audit", F.concat("audit", enrichment.audit_entries())).drop("unasked"), out.outcomes)


RESOLVED = ("municipality", "country", "postal_code", "city", "address")


def _escalate(df: DataFrame, given: Given) -> DataFrame:
    """Values that someone looked up for a record, by id; hints that the record no longer gives are cleared."""
    hints = checks.flags_from_gaps("gaps")
    df = df.withColumn("_hints", F.when(F.size(hints) > 0, hints).otherwise(F.array(F.lit("low_confidence_research"))))
    told = given.resolutions.join(F.broadcast(df.select("id").distinct()), "id", "left_semi") if given.few else given.resolutions
    one = told.groupBy("id").agg(*[F.min(F.nullif(F.col(f), F.lit(""))).alias(f) for f in RESOLVED])
    out = apply_resolutions(df, one, list(RESOLVED))
    told = checks.escalation_outcome(F.col("_hints"), checks.needs_escalation())
    out = out.withColumn("_told", told).withColumn("escalation_flags", F.concat("_told.surviving", checks.array_of(F.when(F.col("_told.cleared"), "resolved_after_escalation"))))
    return noted(out, "escalate", F.when(F.col("_told.cleared"), "resolved").otherwise("not resolved"), F.when(F.col("_told.cleared"), 0.85).otherwise(0.40), F.array_join("resolved_fields", ",")).drop("_hints", "_told", "resolved_fields", "resolution_confidence")


def _categorize(df: DataFrame, given: Given) -> DataFrame:
    category, sure = text.product_category("product_name", "ticket_type", "ticket_category")
    return audited(df.withColumn("_sure", sure), "categorize_product", "ticket_category", lambda d: d.withColumn("ticket_category", category), F.col("_sure")).drop("_sure")


#: Steps by name; a domain's configuration says which of them run, and in what order.
STEPS: dict[str, Callable[[DataFrame, Given], DataFrame]] = {
    "spell_override": lambda df, given: audited(df, "spell_override", "city", lambda d: learning.spell_override(d, "city", given.overrides)),
    "standardize_address": lambda df, given: audited(df, "standardize_address", "address", lambda d: d.withColumn("address", text.standardize_address("address"))),
    "geographic_validate": lambda df, given: df.withColumns(checks.geographic_checks()),
    "fsa_lookup": _fsa_lookup,
    "geocode": _geocode,
    "enrich": lambda df, given: _enrich(df, given).records,
    "escalate": _escalate,
    "normalize_event_name": lambda df, given: audited(df, "normalize_event_name", "event_name", lambda d: d.withColumn("event_name", text.normalize_event_name("event_name"))),
    "categorize_product": _categorize,
}


#: What a step can't run without.
TABLES = {"spell_override": ("overrides",), "fsa_lookup": ("fsa_map",), "geocode": ("geocodes",), "enrich": ("templates", "results"), "escalate": ("resolutions",)}


def _can(step: Step, given: Given) -> bool:
    return step.name in STEPS and all(getattr(given, t) is not None for t in TABLES.get(step.name, ()))


def within_budget(df: DataFrame, step: Step, given: Given) -> DataFrame:
    """df after an expensive step for the first rows by id that the budget allows; the others say so in their audit."""
    run = STEPS[step.name]
    if step.cost != "high" or given.budget is None or step.name == "enrich":  # which spends by query
        return run(df, given)
    granted, n = first_by(df, F.lit(True), given.budget)
    granted = F.coalesce(granted, F.lit(False))
    few = n <= enrichment.RESULTS
    return run(written(df.where(granted), "granted") if few else df.where(granted), replace(given, few=few)).unionByName(noted(df.where(~granted), step.name, F.lit("budget exhausted"), 0.0), allowMissingColumns=True)


def run_steps(df: DataFrame, domain: Domain, given: Given, phases: tuple[int, ...]) -> DataFrame:
    """df after the domain's steps of some phases, in the order of its configuration."""
    for step in domain.ordered():
        if step.phase in phases and _can(step, given):
            df = within_budget(df, step, given)
    return df


def deterministic(df: DataFrame, overrides: DataFrame, domain: Domain = REAL_ESTATE) -> DataFrame:
    """First phase: corrected city, standard address, and audit of what changed; checks are added."""
    return run_steps(df.withColumn("audit", F.array().cast(AUDIT)), domain, Given(overrides), (1,))


def triaged(df: DataFrame, domain: Domain) -> DataFrame:
    """df with route, route_confidence and data_confidence."""
    sure = checks.data_confidence([F.col("municipality_confidence")], [F.col("geographic_validated")])
    r = checks.triage(checks.completeness(domain.required), sure)
    return df.withColumns({"_r": r, "data_confidence": sure}).withColumns({"route": F.col("_r.route"), "route_confidence": F.col("_r.confidence")}).drop("_r")


def planned(df: DataFrame, domain: Domain, given: Given) -> DataFrame:
    """df with ``plan`` (step names) after the steps that each row's plan names: a plan holds for all rows of one signature.

    Each step that any plan names runs once, over the rows whose plan names it, in the domain's order.
    """
    steps = [s for s in domain.ordered() if _can(s, given)]
    fields = [f.name for f in df.schema if f.dataType.typeName() in ("string", "long", "integer") and f.name not in ("id", "route", "error", "fsa", "fsa_municipality")]
    signed = record_signature(df, fields, "data_confidence", domain.name)
    plans = learning.plan_lookup(signed, given.plans, given.at(), [s.name for s in steps]).select("id", "plan")
    df = written(df.join(plans.dropDuplicates(["id"]), "id", "left"), "planned")
    used = {r[0] for r in df.select(F.explode(F.split("plan", ","))).distinct().collect()}
    for step in (s for s in steps if s.name in used):
        named = F.coalesce(F.array_contains(F.split("plan", ","), step.name), F.lit(False))
        ran = within_budget(df.where(named), step, given)
        before, df = df, written(df.where(~named).unionByName(ran, allowMissingColumns=True), "planned")
        discard(before)
    return df


@dataclass(frozen=True)
class Run:
    """records, and what is learned from them: outcomes of queries, and corrections (wrong, fixed, n); None if there is nothing to learn from."""

    records: DataFrame
    outcomes: DataFrame | None = None
    proposals: DataFrame | None = None


def process(df: DataFrame, domain: Domain, given: Given) -> Run:
    """All phases but linkage: every input row comes out once, with route, error and audit.

    Rows that a triage sends to done or unsalvageable skip what follows. A domain without required fields has no triage.
    Bad rows keep their values and carry an error.
    """
    # a small file may be long work: rows are dealt to all cores
    spark = df.sparkSession
    df = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "id")
    df = df.withColumns({"error": F.when(F.col("id").isNull(), "no id"), "audit": F.array().cast(AUDIT)})
    first = run_steps(df, domain, given, (1,))
    if not domain.required:
        return Run(written(run_steps(first, domain, given, (2, 3)).withColumns({"route": F.lit("done"), "route_confidence": F.lit(1.0)}), "records"))
    snapshot = {f"_was_{c}": F.col(c) for c in domain.learnable}
    first = written(triaged(first.withColumns(snapshot), domain), "first")
    second = run_steps(first.where("route = 'needs_review'"), domain, given, (2,))
    outcomes = None
    if all(getattr(given, t) is not None for t in TABLES["enrich"]) and any(s.name == "enrich" for s in domain.steps):
        enriched = _enrich(written(second, "second"), given)
        second, outcomes = enriched.records, enriched.outcomes
    else:
        second = second.withColumn("gaps", _gaps(second))
    second = written(triaged(second, domain), "again")
    review = second.where("route = 'needs_review'")
    if given.plans is not None:
        review = triaged(planned(review, domain, given), domain)
    last = [s for s in domain.ordered() if s.phase == 5 and _can(s, given)]
    if last:
        review = written(review, "review")
        stuck = review.where("route = 'needs_review'")
        for step in last:
            stuck = within_budget(stuck, step, given)
        review = review.where("route <> 'needs_review'").unionByName(triaged(stuck, domain), allowMissingColumns=True)
    parts = [first.where("route <> 'needs_review'"), second.where("route <> 'needs_review'"), review]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = written(out, "records")
    proposals = learning.small_changes(out.where("error IS NULL"), [(f"_was_{c}", c) for c in domain.learnable]) if domain.learnable else None
    return Run(out.drop(*snapshot), outcomes, proposals)


def routed(df: DataFrame, domain: Domain, given: Given) -> DataFrame:
    """The records of ``process``."""
    return process(df, domain, given).records


def linked(out: DataFrame, domain: Domain) -> DataFrame:
    """Records (written) with flags, audit_entries and, where the domain links, group_id."""
    if any(s.name == "link" for s in domain.ordered()):
        links = [x for x in (linkage.by_fuzzy_text(out, domain.blocks, domain.rules), linkage.by_exact_keys(out, domain.blocks, domain.rules)) if x is not None]
        out = linkage.link_components(out, reduce(DataFrame.unionByName, links))
    flags = F.array().cast("array<string>")
    if domain.required:
        flags = F.when(F.col("route") == "done", flags).otherwise(checks.needs_escalation())
    return out.withColumn("flags", flags).withColumn("audit_entries", F.size("audit").cast("long"))


def clean(df: DataFrame, domain: Domain, given: Given) -> DataFrame:
    """The whole pipeline's records."""
    return linked(routed(df, domain, given), domain)


def steps_table(spark: SparkSession) -> DataFrame:
    """(domain, position, step, phase, cost, needs) in running order."""
    rows = [(d.name, i, s.name, s.phase, s.cost, ",".join(s.needs)) for d in DOMAINS.values() for i, s in enumerate(d.ordered(), 1)]
    return spark.createDataFrame(rows, "domain string, position int, step string, phase int, cost string, needs string")
