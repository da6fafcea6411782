"""Matches in factors, and similar texts against all pairs."""

import random

from pyspark.sql import functions as F

from scrubline.operators import linkage
from scrubline.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def listings(spark):
    from scrubline.plans.fixtures import Tables

    return Tables(spark, SF_DIR).listings


def rebuilt(rows, both):
    """All pairs of rows from pairs of classes and members, as the plain rules give them."""
    members = {}
    for r in rows:
        if r.id is not None:
            members.setdefault((r.rule, r.class_a, r.side if both else 0), []).append(r.id)
    out = {}
    for r in sorted((r for r in rows if r.id is None), key=lambda r: r.rule, reverse=True):  # e-mail first
        for a, b in ((r.class_a, r.class_b), (r.class_b, r.class_a)):
            for x in members.get((r.rule, a, 0), []):
                for y in members.get((r.rule, b, 1 if both else 0), []):
                    if x < y or both and x != y:
                        out.setdefault((x, y), (r.rule, r.confidence))
    return out


def test_match_rules_has_pairs_and_members(spark):
    rows = QUERIES["match_rules"](spark, SF_DIR).collect()
    want = {(r.id_a, r.id_b): (r.rule, r.confidence) for r in linkage.matches(listings(spark), None, ["postal_code"]).collect()}
    assert want and rebuilt(rows, False) == want


def test_link_candidates_has_pairs_and_members_of_both_sides(spark):
    rows = QUERIES["link_candidates"](spark, SF_DIR).collect()
    df = listings(spark)
    want = {(r.id_a, r.id_b): (r.rule, r.confidence) for r in linkage.link_candidates(df, df, ["postal_code"]).collect()}
    assert want and rebuilt(rows, True) == want


def test_similar_texts_meet_once_and_equal_all_pairs(spark):
    """Random edits at two thresholds; a text of 25 bigrams meets others by 4 or 7 of them, where a bound by the bigrams alone took 6 or 11."""
    rng = random.Random(8)
    base = ["1 King St York", "250 St Paul Street Toronto", "aaaa", "abab", "ab", "a", "é😀 x", "33 Oak Blvd NE Ottawa", ""]
    edit = lambda x: "".join(rng.choice([c, c, c, c, c, c, c, c, "", c + rng.choice("ab1 é😀"), rng.choice("ab1 ")]) for c in x)
    texts = sorted({edit(b) for b in base * 14} | set(base))
    df = spark.createDataFrame([(k, x) for x in texts for k in ("p", None)], "block string, x string")
    pairs = spark.createDataFrame([(x, y) for x in texts for y in texts if x < y], "x_a string, x_b string")
    every = pairs.withColumn("s", linkage.fuzzy_similarity(F.col("x_a"), F.col("x_b"))).collect()
    for threshold in (0.6, 0.8, 0.9):
        want = {(r.x_a, r.x_b): round(r.s, 9) for r in every if r.s >= threshold}
        got = [((r.x_a, r.x_b), round(r.similarity, 9)) for r in linkage.similar_texts(df, ["block"], threshold).collect()]
        assert want and len(got) == len(want) and dict(got) == want
    most = spark.range(1).select(*[linkage._edits(t, F.lit(25), F.lit(26)).alias(n) for t, n in ((0.8, "x"), (0.9, "y"))]).first()
    assert (most.x + 1, most.y + 1) == (7, 4)
