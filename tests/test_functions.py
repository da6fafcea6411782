"""Small input and expected pairs of the column functions and table operators."""

import pytest
from pyspark.sql import functions as F

from scrubline.functions import checks, missing, places, text
from scrubline.operators import learning, linkage, spatial, tables, vectors
from scrubline.plans import pipeline


def one(spark, column, **values):
    kinds = {int: "long", float: "double", str: "string", bool: "boolean", type(None): "string", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "want"), [("o'brien", "O'Brien"), ("33rd street", "33Rd Street"), ("ÉTOBICOKE north", "Étobicoke North"), ("", ""), (None, None)])
def test_title_case(spark, given, want):
    assert one(spark, text.title_case("a"), a=given) == want


@pytest.mark.parametrize(("given", "want"), [("12 King st  NE", "12 King Street Northeast"), ("1 St Paul Ave", "1 Street Paul Avenue"), ("5 Oak St.", "5 Oak Street."), (None, None)])
def test_standard_address(spark, given, want):
    assert one(spark, text.standardize_address("a"), a=given) == want


def test_units_go_if_asked(spark):
    assert one(spark, text.standardize_address("a", True), a="12 King St, Apt 4") == "12 King Street"


@pytest.mark.parametrize(("given", "want"), [("12 n main st., unit 3", "N Main Street"), ("", ""), (None, "")])
def test_cache_key(spark, given, want):
    assert one(spark, text.address_cache_key("a"), a=given) == want


@pytest.mark.parametrize(("given", "want"), [("Leafs vs. habs", "toronto maple leafs vs montreal canadiens"), ("A - B", "A - B"), ("Jets @ Foo", "winnipeg jets vs Foo"), (None, None)])
def test_event_names(spark, given, want):
    assert one(spark, text.normalize_event_name("a"), a=given) == want


@pytest.mark.parametrize(("given", "want"), [('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('say {"b": 2} end', '{"b": 2}'), ("none", None), (None, None)])
def test_extract_json(spark, given, want):
    assert one(spark, text.extract_json("a"), a=given) == want


def test_templates_skip_missing_fields(spark):
    f = text.fill_template(F.lit("{x} in {y}"), {"x": "a", "y": "b"})
    assert one(spark, f, a="p", b="q") == "p in q"
    assert one(spark, f, a="p", b=None) is None
    assert one(spark, text.fill_template(F.lit("{z}"), {"x": "a"}), a="p") is None


@pytest.mark.parametrize(("phone", "country", "want"), [("4165550123", "CA", "(416) 555-0123"), ("1-416-555-0123", "Canada", "(416) 555-0123"), ("020 5555555", "NL", "+31 205555555"), ("+31 20 5555555", "NL", "+31 205555555"), ("555", "CA", "N/A"), (None, "CA", "N/A"), ("4165550123", None, "(416) 555-0123")])
def test_phones(spark, phone, country, want):
    assert one(spark, places.format_phone("a", "b"), a=phone, b=country) == want


@pytest.mark.parametrize(("code", "want"), [("M6H 1E7", "full"), ("m6h", "partial"), ("", "missing"), (None, "missing"), ("12", "malformed")])
def test_postal_class(spark, code, want):
    assert one(spark, places.postal_class("a"), a=code) == want


def test_cross_province(spark):
    c = places.cross_province("p", "s", "c")
    assert one(spark, c, p="M6H 1E7", s="QC", c="CA") is True
    assert one(spark, c, p="X0A 0A0", s="NU", c=None) is False
    assert one(spark, c, p=None, s="QC", c="CA") is None


def test_missing_rules(spark):
    assert [one(spark, f("a"), a="0") for f in (missing.is_falsy, missing.is_blank, missing.is_blank_or_na)] == [True, False, False]
    assert [one(spark, f("a"), a=" n/a ") for f in (missing.is_falsy, missing.is_blank, missing.is_blank_or_na)] == [False, False, True]
    assert [one(spark, f("a"), a=None) for f in (missing.is_falsy, missing.is_blank, missing.is_blank_or_na)] == [True, True, True]


def test_gaps(spark):
    assert one(spark, checks.build_gap("mismatch", ["b", "a"], F.lit(" Q "))) == "mismatch:a+b|q"
    p = one(spark, checks.parse_gap("a"), a="missing:x+y| K ")
    assert (p["verb"], p["fields"], p["qualifier"]) == ("missing", ["x", "y"], "k")
    assert one(spark, checks.is_valid_gap("a"), a="lost:x") is False
    assert one(spark, checks.is_valid_gap("a"), a="missing:") is False
    with pytest.raises(ValueError):
        checks.build_gap("lost", "x")


@pytest.mark.parametrize(("complete", "confidence", "route"), [(1.0, 0.9, "done"), (0.8, 0.85, "done"), (0.75, 0.9, "needs_review"), (1.0, 0.6, "needs_review"), (1.0, 0.59, "unsalvageable"), (0.6, 0.9, "unsalvageable")])
def test_triage(spark, complete, confidence, route):
    assert one(spark, checks.triage(F.col("c"), F.col("d")), c=complete, d=confidence)["route"] == route


def test_additive_score(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, checks.additive_score(t, t, t, f, f))["route"] == "auto_complete"
    assert one(spark, checks.additive_score(f, f, f, t, t))["score"] == 0.0


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 1.0), ("", "abc", 0.0), ("", "", 0.0), ("ab", "ac", 0.25)])
def test_similarity(spark, a, b, want):
    assert one(spark, linkage.fuzzy_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_links_are_transitive_and_nulls_do_not_link(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", None), (4, None, None), (5, None, None)], "id long, email string, address string").withColumn("block", F.lit("b"))
    links = linkage.by_exact_keys(df, ["block"], linkage.RULES).unionByName(spark.createDataFrame([(2, 3)], "id_a long, id_b long"))
    got = {r["id"]: r["group_id"] for r in linkage.link_components(df, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_long_chain_of_links(spark):
    n = 200
    df = spark.range(n)
    links = df.where("id > 0").select((F.col("id") - 1).alias("id_a"), F.col("id").alias("id_b"))
    assert {r["group_id"] for r in linkage.link_components(df, links).collect()} == {0}


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", "k"), (None, "n", "k")], "k long, v string, w string")
    rows = spark.createDataFrame([(1, "b", "x", 1), (1, "c", "x", 2), (2, "d", "x", 1), (None, "m", "x", 1)], "k long, v string, w string, o int")
    once = tables.upsert(target, rows, ["k"], ["v"], "o")
    assert sorted(once.collect(), key=repr) == sorted(tables.upsert(once, rows, ["k"], ["v"], "o").collect(), key=repr)
    assert {(r.k, r.v, r.w) for r in once.collect()} == {(1, "c", "k"), (2, "d", "x"), (None, "m", "k")}


def test_unknown_columns_are_errors(spark):
    with pytest.raises(ValueError):
        tables.query_rows(spark.range(3), {"nothing": 1})
    with pytest.raises(ValueError):
        tables.update_fields(spark.range(3), spark.range(1), ["id"], F.array())


def test_persist_writes_three_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [("s", 1)], ["f"]), (2, [], [])], "id long, audit array<struct<skill: string, n: int>>, flags array<string>")
    tables.persist(df, str(tmp_path), "r1")
    assert [spark.read.parquet(f"{tmp_path}/{t}").count() for t in ("cleaned", "audit", "flags")] == [2, 1, 1]


def test_concave_polygon(spark):
    ring = [(0, 0), (40, 0), (40, 40), (20, 10), (0, 40)]
    polygons = spark.createDataFrame([(1, 1, [(float(x), float(y)) for x, y in ring])], "polygon_id int, ord int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 20.0, 5.0), (2, 20.0, 30.0), (3, 5.0, 20.0), (4, 99.0, 1.0)], "point_id int, x double, y double")
    assert {r["point_id"] for r in spatial.point_in_polygon(points, polygons).collect()} == {1, 3}


def test_swap_counts_one_edit(spark):
    values = spark.createDataFrame([("Toronot",), ("torontoo",), ("xx",), (None,)], "v string")
    terms = spark.createDataFrame([("toronto", 5), ("torontos", 9)], "term string, n long")
    got = {r["value"]: r["suggestion"] for r in learning.spell_dictionary(values, "v", terms).collect()}
    assert got == {"toronot": "toronto", "torontoo": "torontos"}


def test_lsh_candidates_recall(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = base.where("vec_id % 5 = 0")
    got = {(r.query_id, r.vec_id) for r in vectors.candidates(q, base, 0.9, tables=12, bucket=1.0).collect()}
    want = {(r.query_id, r.vec_id) for r in vectors.topk_cosine(q, base, 50).where("similarity >= 0.9").collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_cycles_and_missing_steps_are_errors():
    step = pipeline.Step
    with pytest.raises(ValueError, match="cycle"):
        pipeline.Domain("d", (step("a", 1, "low", ("b",)), step("b", 1, "low", ("a",)))).ordered()
    with pytest.raises(ValueError, match="no step"):
        pipeline.Domain("d", (step("a", 1, "low", ("b",)),)).ordered()


def plain_matches(rows, block, rules):
    """All pairs of a block, the first rule that matches; rules with an empty field are skipped."""
    norm = lambda v: (v or "").strip().lower()

    def similarity(x, y):
        if x == y:
            return 1.0
        grams = [{t[i : i + 2] for i in range(len(t) - 1)} or {t} for t in (x, y)]
        table = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            table, before = [i], table
            for j, d in enumerate(y, 1):
                table.append(min(before[j] + 1, table[-1] + 1, before[j - 1] + (c != d)))
        return 0.5 * len(grams[0] & grams[1]) / len(grams[0] | grams[1]) + 0.5 * (1 - table[-1] / max(len(x), len(y)))

    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[block] is None or a[block] != b[block]:
                continue
            for r in rules:
                x, y = ([norm(v[f]) for f in r.fields] for v in (a, b))
                if not all([*x, *y]):
                    continue
                sim = float(x == y) if r.kind == "exact" else similarity(" ".join(x), " ".join(y))
                if sim >= (1 if r.kind == "exact" else r.threshold):
                    out[min(a["id"], b["id"]), max(a["id"], b["id"])] = (r.name, r.weight if r.kind == "exact" else round(sim * r.weight, 3))
                    break
    return out


def test_matches_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    streets = ["12 King Street", "12 King Stret", "14 King Street", "9 Queen Road", "9 Queen Roade", "", None]
    rows = [{"id": i, "block": rng.choice(["a", "b", None]), "email": rng.choice(["x@y.z", "q@r.s", "", None]), "address": rng.choice(streets), "city": rng.choice(["Toronto", "Torontoo", "", None])} for i in range(90)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, block string, email string, address string, city string")
    rules = (linkage.Rule("email", ("email",)), linkage.Rule("address", ("address", "city"), "fuzzy", 0.8, 0.9))
    want = plain_matches(rows, "block", rules)
    got = {(r.id_a, r.id_b): (r.rule, r.confidence) for r in linkage.matches(df, None, ["block"], rules).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 0.002 for k in got)
    both = {(r.id_a, r.id_b) for r in linkage.link_candidates(df, df, ["block"], rules).collect()}
    assert both == {p for k in want for p in (k, k[::-1])}
    links = linkage.by_fuzzy_text(df, ["block"], rules).unionByName(linkage.by_exact_keys(df, ["block"], rules))
    every = spark.createDataFrame(list(want), "id_a long, id_b long")
    groups = [{r.id: r.group_id for r in linkage.link_components(df, x).collect()} for x in (links, every)]
    assert groups[0] == groups[1] and links.count() < every.count()


def test_a_rule_with_an_empty_field_and_other_blocks_do_not_link(spark):
    rows = [(1, "p1", "a@b.c", "12 King Street", ""), (2, "p1", "", "12 King Street", ""), (3, "p2", "a@b.c", "1 Other Road", "Ottawa")]
    df = spark.createDataFrame(rows, "id long, block string, email string, address string, city string")
    assert linkage.matches(df, None, ["block"]).count() == 0
    assert linkage.by_fuzzy_text(df, ["block"], linkage.RULES).unionByName(linkage.by_exact_keys(df, ["block"], linkage.RULES)).count() == 0


def test_fields_are_cleaned_by_type(spark):
    from scrubline.operators import fields

    types = fields.field_types(["zip", "sex", "ssn", "note", "country"], {"zip": "postal_code"}, {"ssn"}, {"sex": "gender"})
    assert types == {"zip": "postal_code", "sex": "gender", "ssn": "sensitive", "country": "country"}
    rules = {"gender": fields.FieldRule({"m": "Male", "male": "Male"}, reject=("^[a-zA-Z]$",)), "postal_code": fields.FieldRule(valid=("^[0-9]{5}$",))}
    df = spark.createDataFrame([(1, "12345", "m", "secret", None), (2, "1", "T", "secret", ""), (3, " ", "femme", None, "x"), (4, "9", "Q", None, "y")], "id long, zip string, sex string, ssn string, country string")
    learned = spark.createDataFrame([("gender", "femme", "Female", 0.95, True), ("gender", "q", "Other", 0.95, False)], "field_type string, raw string, corrected string, confidence double, enabled boolean")
    told = spark.createDataFrame([(2, "sex", "Male", 0.95), (2, "zip", "00001", 0.75), (4, "zip", "00009", 0.5)], "id long, field string, corrected string, confidence double")
    out = fields.clean_fields(df, types, rules, learned, told)
    got = {(r.id, r.field): (r.value, r.outcome) for r in out.collect()}
    assert got == {
        (1, "zip"): ("12345", "valid"), (1, "sex"): ("Male", "mapped"), (1, "ssn"): (None, "skipped: sensitive field"), (2, "ssn"): (None, "skipped: sensitive field"), (2, "zip"): ("00001", "needs_review"),
        (2, "sex"): ("Male", "resolved"), (3, "sex"): ("Female", "learned"), (3, "country"): ("x", "open"), (4, "zip"): ("9", "unresolvable"), (4, "sex"): ("Q", "open"), (4, "country"): ("y", "open"),
    }
    assert [(r.raw, r.corrected) for r in fields.newly_learned(out).collect()] == [("t", "Male")]
    assert all(r.original is None for r in out.where("field = 'ssn'").collect())


def test_matches_of_a_hot_key_grow_with_rows(spark):
    """Equal rows are members of a class: no more rows come out than go in, and the classes stand for every pair."""
    n = 3000
    rows = spark.range(n).select("id", F.lit("b").alias("block"), F.lit("x@y.z").alias("email"), F.when(F.col("id") % 2 == 0, "12 King Street").otherwise("12 King Stret").alias("address"), F.lit("Toronto").alias("city"))
    classes = linkage.match_classes(rows, None, ["block"])
    pairs = {(r.rule, r.class_a, r.class_b): (r.records_a, r.records_b) for r in classes.pairs.collect()}
    assert pairs == {("email", 0, 0): (n, n), ("address", 0, 0): (n // 2, n // 2), ("address", 1, 1): (n // 2, n // 2), ("address", 0, 1): (n // 2, n // 2)}
    assert classes.members.count() == 2 * n
    some = linkage.match_classes(rows.where("id < 30"), None, ["block"])
    assert linkage.expanded(some).count() == 30 * 29 // 2


def test_an_unsure_boundary_escalates(spark):
    from scrubline.operators import lookups

    rows = [(1, None, "York", None, "", "1 Oak St", "X"), (2, None, "York", None, "york", "1 Oak St", "X"), (3, None, "York", 0.9, "Leeds", "", "X"), (4, "Hull", "York", 0.9, "", "", "X"), (5, None, None, 0.9, "", "", "X"), (6, None, None, 0.7, "Old", "", "X"), (7, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, fsa_municipality string, boundary_municipality string, geocode_confidence double, municipality string, address string, city string")
    got = {r.id: (r.resolved_by, r.resolved_municipality, r.resolved_confidence) for r in lookups.resolve_municipality(df).collect()}
    assert got == {1: ("escalate", None, 0.45), 2: ("boundary", "York", 0.65), 3: ("boundary", "York", 0.10), 4: ("cache", "Hull", 0.95), 5: ("geocode", "X", 0.9), 6: ("review", "Old", 0.0), 7: ("review", None, 0.0)}
