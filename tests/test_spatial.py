"""Points in polygons of very different sizes, against a plain ray cast."""

import random

import pytest

from scrubline.operators import spatial

RING = "polygon_id long, ord int, ring array<struct<x: double, y: double>>"


def held(x, y, ring):
    out = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out = not out
    return out


def test_small_and_huge_polygons_together(spark):
    rng = random.Random(6)
    rings = {0: [(0.0, 0.0), (1e6, 0.0), (1e6, 1e6), (0.0, 1e6)]}
    for i in range(1, 40):
        x, y, r = rng.uniform(-50, 200), rng.uniform(-50, 200), 10 ** rng.uniform(-2, 2)
        rings[i] = [(x + r * rng.random(), y), (x + r, y + r * rng.random()), (x + r * rng.random(), y + r), (x + r / 3, y + r / 2), (x, y + r * rng.random())]
    polygons = spark.createDataFrame([(i, 100 - i, r) for i, r in rings.items()] + [(99, 0, []), (98, 0, None)], RING)
    cells = spatial.cover(polygons).groupBy("polygon_id").count().collect()
    assert max(r["count"] for r in cells) <= (spatial.ACROSS + 1) ** 2
    points = [(i, rng.uniform(-60, 250), rng.uniform(-60, 250)) for i in range(2000)] + [(3000, 5e5, 7e5), (3001, 2e6, 1.0), (3002, None, 1.0)]
    got = {r.point_id: r.polygon_id for r in spatial.point_in_polygon(spark.createDataFrame(points, "point_id long, x double, y double"), polygons).collect()}
    want = {}
    for i, x, y in points:
        inside = [(100 - k, k) for k, r in rings.items() if x is not None and held(x, y, r)]
        if inside:
            want[i] = min(inside)[1]
    assert got == want and got[3000] == 0
    out, counts = spatial.located(spark.createDataFrame(points, "point_id long, x double, y double").selectExpr("*", "CAST(35 AS STRING) AS n"), polygons, "n")
    assert counts.first().asDict() == {"matched": len(want), "unmatched": len(points) - len(want)} and out.first().province_code == "ON"


@pytest.mark.parametrize(("number", "code"), [("24", "QC"), ("59", "BC"), ("x", None), (None, None)])
def test_province_codes(spark, number, code):
    assert spark.createDataFrame([(number,)], "n string").select(spatial.province_code("n").alias("c")).first().c == code
