"""Enrichment within budgets and the later phases of the pipeline, against plain loops over small tables."""

import random
import re

from pyspark.sql import functions as F

from scrubline.operators import enrichment, numbering
from scrubline.plans import pipeline
from tests.test_evidence import plain

TEMPLATES = [
    ("d", "municipality_ambiguous", "{city} map", 9, 1), ("d", "municipality_ambiguous", "{unheard} {city}", 5, 5), ("d", "municipality_ambiguous", "third {city}", 1, 9),
    ("_common", "unknown_email_domain", "{municipality} {name} firm", 8, 2), ("_common", "unknown_email_domain", "who is {name}", 7, 3), ("_common", "municipality_ambiguous", "never", 9, 0),
    ("d", "unknown_phone_format", "{nothing}", 9, 1),
]
FIELD = {"municipality_ambiguous": "municipality", "unknown_email_domain": "email_org"}


def loop(records, results, budget, per_record=3, per_gap=2):
    """Rounds over records by id: the next query of each, while the budget lasts."""
    ranked = {}
    for gap in {t[1] for t in TEMPLATES}:
        own = [t for t in TEMPLATES if t[1] == gap and t[0] == "d"] or [t for t in TEMPLATES if t[1] == gap and t[0] == "_common"]
        ranked[gap] = [t[2] for t in sorted(own, key=lambda t: (-t[3] / (t[3] + t[4]), -t[3], t[2]))[:per_gap]]
    state = {r["id"]: {"r": dict(r), "todo": [(g, t) for g in r["gaps"] or [] for t in ranked.get(g, [])], "asked": [], "halted": False} for r in records if r["route"] == "needs_review" and (r["data_confidence"] or 1) < 0.7 and r["gaps"]}

    def fill(template, r):
        names = re.findall(r"\{(\w+)\}", template)
        return None if any(not str(r.get(n) or "").strip() for n in names) else re.sub(r"\{(\w+)\}", lambda m: str(r[m[1]]), template)

    for _ in range(per_record):
        for i in sorted(state):
            s = state[i]
            fillable = [(g, t) for g, t in s["todo"] if fill(t, s["r"]) is not None]
            if not fillable:
                continue
            if budget == 0:
                s["halted"] = True
                continue
            budget -= 1
            gap, template = fillable[0]
            text = results.get(" ".join(fill(template, s["r"]).lower().split()).rstrip(".,;:!?"))
            value = plain(gap, text) if text else None
            s["asked"].append((gap, template, value is not None))
            rest = s["todo"][s["todo"].index((gap, template)) + 1 :]
            s["todo"] = [(g, t) for g, t in rest if value is None or g != gap]
            if value is not None:
                s["r"][FIELD[gap]] = value
    outcomes = []
    for i, s in state.items():
        left = {g for g, t in s["todo"] if fill(t, s["r"]) is not None}
        won = {g for g, _, ok in s["asked"] if ok}
        for n, (g, t, ok) in enumerate(s["asked"]):
            if ok or (g not in won and g not in left and g not in [a[0] for a in s["asked"][:n]]):
                outcomes.append((i, g, t, ok))
    return {i: s["r"] for i, s in state.items()}, sorted(outcomes), {i: s["halted"] for i, s in state.items()}


def test_rounds_equal_a_loop_over_records(spark):
    rng = random.Random(4)
    gaps = ["municipality_ambiguous", "unknown_email_domain", "unknown_phone_format", "missing:city"]
    records = []
    for i in range(160):
        records.append({"id": i, "name": rng.choice(["Ann", "Bo", "", None]), "city": rng.choice(["Oak", "Elm", "Ash", " ", None]), "municipality": rng.choice([None, "Old"]), "route": rng.choice(["needs_review"] * 5 + ["done"]), "data_confidence": rng.choice([0.65, 0.65, 0.65, 0.7, None]), "gaps": rng.choice([None, [], rng.sample(gaps, rng.randint(1, 4))])})
    results = {"oak map": "The city of Oakville is here", "elm map": "nothing", "new who": "x", "oakville ann firm": "Acme is a company", "who is ann": "Ann Ltd is an organization", "old bo firm": "Old Bo is a company", "who is bo": "error: none"}
    frame = spark.createDataFrame([tuple(r.values()) for r in records], "id long, name string, city string, municipality string, route string, data_confidence double, gaps array<string>").repartition(3)
    templates = spark.createDataFrame(TEMPLATES, "domain string, gap_type string, query_template string, success_count int, failure_count int")
    found = spark.createDataFrame([*results.items(), ("OAK  map!", "The city of Oakville is here"), ("elm map", None)], "query string, text string")
    for budget in (None, 60, 0):
        out = enrichment.enrich(frame, templates, found, "d", budget)
        want, outcomes, halted = loop(records, results, -1 if budget is None else budget)
        got = {r.id: r for r in out.records.collect()}
        assert len(got) == len(records)
        for r in records:
            w = want.get(r["id"], r)
            assert (got[r["id"]].municipality, got[r["id"]].email_org) == (w["municipality"], w.get("email_org")), r
            assert bool(got[r["id"]].unasked) == halted.get(r["id"], False)
        assert sorted((r.id, r.gap_type, r.query_template, r.success) for r in out.outcomes.collect()) == outcomes
    assert outcomes == [] and any(halted.values())


def test_nth_least_by_counts(spark):
    ids = random.Random(2).sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    assert [numbering.nth_least(df, "id", n) for n in (1, 250, 500, 501, 0)] == [sorted(ids)[0], sorted(ids)[249], sorted(ids)[-1], None, None]


COLUMNS = "id long, name string, address string, city string, postal_code string, municipality string, state_province string, country string, municipality_confidence double"
ROWS = [
    (1, "Ann", "1 Oak St", "Toronot", "M1A 1A1", "Toronto", "ON", "CA", 0.95),  # done at once
    (2, "Bo", "2 Oak St", "Toronto", "M1A 1A1", None, "ON", "CA", 0.65),  # done after the lookup
    (3, "Cy", "3 Oak St", "Toronto", "Z9Z 9Z9", "York", "ON", "CA", 0.65),  # the lookup fails
    (4, "Di", "4 Oak St", "Torontoo", None, "Ottawa", "ON", "CA", 0.65),  # nothing to look up: planned, then escalated
    (5, "Ed", "5 Oak St", "Ottawa", None, "Ottawa", "ON", "CA", 0.65),  # the same, beyond the budget
    (6, None, None, "Ottawa", None, "Ottawa", "ON", "CA", 0.65),  # hopeless
    (None, "Fy", "6 Oak St", "Ottawa", "M1A 1A1", "Ottawa", "ON", "CA", 0.95),
]


def given(spark, **more):
    table = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    return pipeline.Given(
        overrides=table([("toronot", "toronto")], "wrong string, fixed string"),
        fsa_map=table([("M1A", "Toronto")], "fsa string, normalized_municipality string"),
        resolutions=table([(4, "Ottawa", "CA", "K1A 0B1", "Toronto", ""), (4, "Ottawa", None, None, None, None)], "id long, municipality string, country string, postal_code string, city string, address string"),
        **more,
    )


def test_later_phases(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    run = pipeline.process(df, pipeline.REAL_ESTATE, given(spark, budget=1))
    got = {r.id: r for r in run.records.collect()}
    assert len(got) == len(ROWS)
    assert {i: r.route for i, r in got.items()} == {1: "done", 2: "done", 3: "unsalvageable", 4: "needs_review", 5: "needs_review", 6: "unsalvageable", None: "done"}
    assert got[1].city == "Toronto" and got[None].error == "no id"
    assert (got[4].city, got[4].postal_code) == ("Toronto", "K1A 0B1") and got[5].postal_code is None
    said = {i: [(a.skill, a.corrected) for a in r.audit] for i, r in got.items()}
    assert ("escalate", "budget exhausted") in said[5] and ("escalate", "resolved") in said[4]
    assert got[4].escalation_flags is not None and got[5].escalation_flags is None
    # only what changed after the first phase is learned
    assert [(r.wrong, r.fixed) for r in run.proposals.collect()] == [("torontoo", "toronto")]


def test_routes_follow_the_lookup(spark):
    got = {r.id: r for r in pipeline.process(spark.createDataFrame(ROWS, COLUMNS), pipeline.REAL_ESTATE, given(spark)).records.collect()}
    assert {i: r.route for i, r in got.items()} == {1: "done", 2: "done", 3: "unsalvageable", 4: "needs_review", 5: "needs_review", 6: "unsalvageable", None: "done"}
    assert got[2].municipality == "Toronto" and got[3].municipality == "York"


def test_a_plan_runs_its_steps_over_the_rows_that_name_it(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    geocodes = spark.createDataFrame([(1,)], "x int").select(F.lit("no").alias("query_hash"), F.lit("1").alias("lat"), F.lit("2").alias("lon"), F.lit("x").alias("display_name"), F.expr("timestamp'2024-12-31 00:00:00'").alias("fetched_at"))
    base = given(spark, geocodes=geocodes)
    review = pipeline.process(df, pipeline.REAL_ESTATE, base).records.where("id IN (4, 5)").drop("escalation_flags")
    fields = [f.name for f in review.schema if f.dataType.typeName() in ("string", "long", "integer") and f.name not in ("id", "route", "error", "fsa", "fsa_municipality")]
    signed = pipeline.record_signature(review, fields, "data_confidence", "real_estate").collect()
    signature = {r.id: r.signature for r in signed}
    assert len(set(signature.values())) == 2  # one has a postal code by now
    plans = spark.createDataFrame([(signature[4], ["escalate", "unheard of", "spell_override"], "2030-01-01"), (signature[4], ["link"], "2026-01-01"), (signature[5], ["escalate"], "2020-01-01")], "signature string, steps array<string>, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    import dataclasses

    out = {r.id: r for r in pipeline.planned(review, pipeline.REAL_ESTATE, dataclasses.replace(base, plans=plans)).collect()}
    assert out[4].plan == "spell_override,escalate" and not out[5].plan
    assert [a.skill for a in out[4].audit if a.skill == "escalate"] == ["escalate"] * 2 and "escalate" in [a.skill for a in out[5].audit]


def test_few_and_many_queries_find_the_same(spark, monkeypatch):
    """Results are looked at for what is asked only; many queries are joined with all answers, written once."""
    results = spark.createDataFrame([(" Code  K1A.", "b"), ("code k1a", "a"), ("code k1a", ""), ("other", "x"), ("bad", "Error: x"), (None, "y")], "query string, text string")
    asked = spark.createDataFrame([("code k1a",), ("bad",), ("never",)], "key string")
    assert [tuple(r) for r in enrichment.one_result(results, asked).collect()] == [("code k1a", "a")]
    assert {tuple(r) for r in enrichment.one_result(results).collect() if r.key} == {("code k1a", "a"), ("other", "x")}
    rows = [(i, "needs_review", 0.65, ["postal_unresolved"], f"K{i}A", None) for i in range(8)]
    frame = spark.createDataFrame(rows, "id long, route string, data_confidence double, gaps array<string>, postal_code string, municipality string")
    templates = spark.createDataFrame([("d", "postal_unresolved", "code {postal_code}", 3, 1)], "domain string, gap_type string, query_template string, success_count int, failure_count int")
    found = spark.createDataFrame([(f"code k{i}a", "Deliveries to Toronto.") for i in range(0, 8, 2)], "query string, text string")
    seen = []
    for bound in (enrichment.RESULTS, 0):
        monkeypatch.setattr(enrichment, "RESULTS", bound)
        seen.append(sorted((r.id, r.municipality, len(r.evidence)) for r in enrichment.enrich(frame, templates, found, "d").records.collect()))
    assert seen[0] == seen[1] == [(i, None if i % 2 else "Toronto", 1 - i % 2) for i in range(8)]
