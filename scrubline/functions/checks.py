"""Validation, gaps, flags and confidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import col, is_blank, is_blank_or_na, is_falsy
from .places import ACCEPTED_COUNTRIES, CA_PROVINCES, ONTARIO_KNOWN, POSTAL_PATTERNS, US_STATES, country_code

VERBS = ("missing", "malformed", "ambiguous", "mismatch", "out_of_range")
#: (verb, first field) -> flag.
GAP_FLAGS = {"missing:country": "unknown_country", "missing:postal_code": "postal_unresolved", "missing:municipality": "municipality_unresolved", "ambiguous:postal_code": "postal_ambiguous"}


def array_of(*items: Column) -> Column:
    """The items that aren't null, in order."""
    return F.array_compact(F.array(*items))


# --- gaps -------------------------------------------------------------------------------------


def build_gap(verb: str, fields: str | list[str], qualifier: str | Column | None = None) -> Column:
    """verb:field[+field][|qualifier]; several fields are sorted, a blank qualifier is left out."""
    if verb not in VERBS:
        raise ValueError(f"unknown gap verb: {verb!r}")
    head = F.lit(f"{verb}:{fields if isinstance(fields, str) else '+'.join(sorted(fields))}")
    if qualifier is None:
        return head
    q = F.lower(F.trim(col(qualifier).cast("string")))
    return F.when(F.coalesce(q, F.lit("")) != "", F.concat(head, F.lit("|"), q)).otherwise(head)


def parse_gap(gap: str | Column) -> Column:
    """struct(verb, fields, qualifier); lenient, the verb isn't checked."""
    g = col(gap)
    body = F.split_part(g, F.lit("|"), F.lit(1))
    qualifier = F.when(F.instr(g, "|") > 0, F.nullif(F.lower(F.trim(g.substr(F.length(body) + 2, F.length(g)))), F.lit("")))
    fields = F.when(F.instr(body, ":") > 0, body.substr(F.instr(body, ":") + 1, F.length(body))).otherwise("")
    return F.struct(F.split_part(body, F.lit(":"), F.lit(1)).alias("verb"), F.when(fields == "", F.array().cast("array<string>")).otherwise(F.split(fields, r"\+")).alias("fields"), qualifier.alias("qualifier"))


def is_valid_gap(gap: str | Column) -> Column:
    p = parse_gap(gap)
    return p["verb"].isin(*VERBS) & (F.size(p["fields"]) >= 1) & ~F.array_contains(p["fields"], "")


def classify_gaps(config: dict[str, str | None]) -> Column:
    """missing:column for each configured column that is blank, qualified by its discriminator column's value."""
    return F.array_distinct(array_of(*[F.when(is_blank(c), build_gap("missing", c, by)) for c, by in config.items()]))


def identify_gaps(gaps: Column, unknown_fsa: Column, confidence: Column, hints: Column | None = None) -> Column:
    """Classified gaps, then what lookups and hints add."""
    more = array_of(F.when(unknown_fsa, "postal_unresolved"), F.when(confidence < 0.70, "municipality_ambiguous"))
    return F.array_distinct(F.concat(gaps, more, F.coalesce(hints, F.array().cast("array<string>")) if hints is not None else F.array().cast("array<string>")))


def flags_from_gaps(gaps: Column) -> Column:
    """The flags that gaps stand for, each once, in order."""
    first = F.transform(gaps, lambda g: F.split_part(F.split_part(g, F.lit("|"), F.lit(1)), F.lit("+"), F.lit(1)))
    table = F.create_map(*[F.lit(x) for kv in GAP_FLAGS.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(first, lambda g: F.element_at(table, g))))


def needs_escalation(country="country", postal="postal_code", municipality="municipality", notes: Column | None = None) -> Column:
    """The flags that call for another pass over a record; empty if it is resolved."""
    p = F.trim(F.coalesce(col(postal), F.lit("")))
    known = F.upper(F.trim(F.coalesce(col(country), F.lit("")))).isin(*ACCEPTED_COUNTRIES)
    note = F.upper(F.coalesce(notes if notes is not None else F.lit(""), F.lit("")))
    return array_of(
        F.when(~known, "unknown_country"),
        F.when(is_blank_or_na(postal), "postal_unresolved").when(p.endswith("?"), "postal_ambiguous"),
        F.when(is_blank_or_na(municipality), "municipality_unresolved"),
        F.when(note.contains("LOW") & note.contains("CONFIDENCE"), "low_confidence_research"),
    )


def escalation_outcome(hints: Column, after: Column) -> Column:
    """struct(surviving, cleared): hints that can't be detected or are raised again survive; the others are cleared."""
    detectable = ["unknown_country", "postal_unresolved", "postal_ambiguous", "municipality_unresolved", "low_confidence_research"]
    surviving = F.filter(hints, lambda h: ~h.isin(*detectable) | F.array_contains(after, h))
    return F.struct(surviving.alias("surviving"), (F.size(surviving) < F.size(hints)).alias("cleared"))


# --- validation -------------------------------------------------------------------------------


def postal_matches(postal: str | Column, country: str | Column) -> Column:
    """Does the upper-cased code, without spaces, have its country's form; countries without one pass. Null if blank."""
    bare = F.replace(F.upper(col(postal)), F.lit(" "), F.lit(""))
    form = None
    for c, p in POSTAL_PATTERNS.items():
        form = F.when(country == c, bare.rlike(p)) if form is None else form.when(country == c, bare.rlike(p))
    return F.when(F.coalesce(col(postal), F.lit("")) != "", form.otherwise(True))


def geographic_checks(country="country", province="state_province", postal="postal_code", municipality="municipality") -> dict[str, Column]:
    """postal_ok, province_ok, municipality_confidence_check (null where not checked), geographic_validated (was anything checked)."""
    c = F.upper(F.coalesce(col(country), F.lit("CA")))
    p = F.upper(F.coalesce(col(province), F.lit("")))
    postal_ok = postal_matches(postal, c)
    province_ok = F.when(p != "", F.when(c == "CA", p.isin(*CA_PROVINCES)).when(c == "USA", p.isin(*[s for s in US_STATES if s != "DC"])))
    hierarchy = F.when((c == "CA") & (p == "ON") & (F.coalesce(col(municipality), F.lit("")) != ""), F.when(col(municipality).isin(*ONTARIO_KNOWN), 0.95).otherwise(0.70))
    return {
        "postal_ok": postal_ok,
        "province_ok": province_ok,
        "hierarchy_confidence": hierarchy,
        "geographic_validated": postal_ok.isNotNull() | province_ok.isNotNull() | hierarchy.isNotNull(),
    }


def violations(age="age", country="country", state="state_province", phone="phone") -> Column:
    """What keeps a record from being written, by name and in order."""
    code = country_code(country)
    us, nl = code == "US", code == "NL"
    given = F.coalesce(col(state), F.lit("")) != ""
    return array_of(
        F.when(col(age).isNotNull() & ~col(age).between(1, 120), "age"),
        F.when((F.coalesce(col(country), F.lit("")) != "") & code.isNull(), "country"),
        F.when(us & given & F.upper(col(state)).isin(*US_STATES), "state_abbreviation").when(us & given & ~col(state).isin(*US_STATES.values()), "state_unknown"),
        F.when(nl & ~F.coalesce(col(phone), F.lit("")).isin("", "N/A") & ~col(phone).startswith("+31"), "nl_phone"),
    )


# --- confidence and triage --------------------------------------------------------------------


def completeness(required: list[str]) -> Column:
    """The share of required fields that are there; 1.0 if none is required."""
    if not required:
        return F.lit(1.0)
    return sum((F.when(is_falsy(c), 0).otherwise(1) for c in required[1:]), F.when(is_falsy(required[0]), 0).otherwise(1)) / F.lit(float(len(required)))


def data_confidence(signals: list[Column], validated: list[Column], baseline: float = 0.9) -> Column:
    """The least of the baseline, the signals that are there, and 0.85 for each flag that is true."""
    return F.least(F.lit(baseline), F.lit(None).cast("double"), *signals, *[F.when(v, 0.85) for v in validated])


def triage(complete: Column, confidence: Column) -> Column:
    """struct(route, confidence): done, needs_review or unsalvageable."""
    done = (confidence >= 0.85) & (complete >= 0.8)
    review = ~done & (confidence >= 0.60) & (complete >= 0.7)
    route = F.when(complete < 0.7, "unsalvageable").when(done, "done").when(review, "needs_review").otherwise("unsalvageable")
    sure = F.when(complete < 0.7, 1.0).when(done, F.least(confidence, complete)).when(review, confidence).otherwise(1.0)
    return F.struct(route.alias("route"), sure.alias("confidence"))


def additive_score(fsa: Column, polygon: Column, upstream: Column, street: Column, conflict: Column) -> Column:
    """struct(score, route) of signals: .35, .35, .20, .10, less .25 for a conflict, at least 0, to two places."""
    parts = [F.when(c, w).otherwise(0.0) for c, w in ((fsa, 0.35), (polygon, 0.35), (upstream, 0.20), (street, 0.10))]
    raw = parts[0] + parts[1] + parts[2] + parts[3]
    score = F.round(F.when(conflict, F.greatest(raw - 0.25, F.lit(0.0))).otherwise(raw), 2)
    route = F.when(score >= 0.85, "auto_complete").when(score >= 0.60, "agent_review").otherwise("human_review")
    return F.struct(score.alias("score"), route.alias("route"))
