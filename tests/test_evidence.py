"""Reading search results for what fills a gap: equal to a plain reading, and in linear time."""

import random
import re
import time

import pytest

from scrubline.operators import learning

FIRM = re.compile(r"([A-Z][a-zA-Z\s]+?)\s+is\s+(?:a|an)\s+(?:company|organization|corporation)", re.I)
PLACE = re.compile(r"(?:municipality|city|town|village)\s+(?:of\s+)?([A-Z][a-zA-Z\s]+?)(?:\.|,|\s+is|\s+has)", re.I)


def plain(gap, text):
    m = (FIRM if gap == "unknown_email_domain" else PLACE).search(text)
    value = m.group(1).strip() if m else ""
    return (value or None) if gap == "unknown_email_domain" else value.title() if 3 <= len(value) <= 50 else None


def test_names_are_read_as_plainly(spark):
    rng = random.Random(1)
    parts = "city town of is a an company Foo Bar has village intercity citywide x . , ( 7 organization island".split()
    texts = [rng.choice(["", ". "]) + "".join(rng.choice(parts) + rng.choice([" ", " ", "  ", ""]) for _ in range(rng.randint(3, 14))) for _ in range(3000)]
    rows = [(i, g, t) for i, t in enumerate([*texts, "", None]) for g in ("unknown_email_domain", "municipality_ambiguous")]
    got = {(r.i, r.gap): r.e.value for r in learning.read_evidence(spark.createDataFrame(rows, "i long, gap string, text string")).collect()}
    for i, gap, t in rows:
        assert got.get((i, gap)) == plain(gap, t or ""), t
    assert len(got) > 500


@pytest.mark.parametrize("text", ["a" * 1_000_000, "city of a " * 100_000, "foo is " * 140_000, " " * 1_000_000, "x  " * 300_000], ids=len)
def test_long_texts_are_read_in_linear_time(spark, text):
    gaps = ("unknown_email_domain", "municipality_ambiguous", "postal_unresolved", "unknown_country", "unknown_phone_format")
    df = spark.createDataFrame([(g, text) for g in gaps], "gap string, text string").coalesce(1)
    start = time.time()
    assert learning.read_evidence(df).count() == 0
    assert time.time() - start < 10
