"""Points in polygons by covers of cells whose size follows each polygon's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A polygon's bounding box is cut into at most so many cells along each axis, and one more.
ACROSS = 8

#: Numbers of provinces -> codes.
PROVINCES = {10: "NL", 11: "PE", 12: "NS", 13: "NB", 24: "QC", 35: "ON", 46: "MB", 47: "SK", 48: "AB", 59: "BC", 60: "YT", 61: "NT", 62: "NU"}


def province_code(number: str | Column) -> Column:
    """The code of a province's number; null for others."""
    n = F.expr(f"try_cast({number} AS INT)") if isinstance(number, str) else number.try_cast("int")
    return F.coalesce(*[F.when(n == k, v) for k, v in PROVINCES.items()])


def _edges(ring: str = "ring") -> str:
    return f"zip_with({ring}, concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1)), (a, b) -> named_struct('a', a, 'b', b))"


def inside(x: str = "x", y: str = "y") -> Column:
    """Is a point in a ring, by the corners' crossings of a ray?"""
    crossings = f"""aggregate({_edges()}, 0, (n, e) -> n + IF((e.a.y > {y}) <> (e.b.y > {y}) AND {x} < (e.b.x - e.a.x) * try_divide({y} - e.a.y, e.b.y - e.a.y) + e.a.x, 1, 0))"""
    return F.expr(f"{crossings} % 2 = 1")


def cover(polygons: DataFrame) -> DataFrame:
    """(polygon_id, ord, ring, level, gx, gy, whole): cells of side 2^level over each polygon, few whatever its size.

    The level is the least at which the bounding box has ACROSS cells along its longer side, or one more. A cell that no
    edge comes near is wholly inside or outside: those outside are left out, and those inside (whole) need no ray.
    """
    side = lambda f, k: f(F.transform("ring", lambda c: c[k]))
    boxed = polygons.where(F.size("ring") > 0).select("polygon_id", "ord", "ring", side(F.array_min, "x").alias("x0"), side(F.array_max, "x").alias("x1"), side(F.array_min, "y").alias("y0"), side(F.array_max, "y").alias("y1"))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    # the size of coordinates bounds the level from below, so that cell numbers stay exact
    reach = F.greatest(*[F.abs(c) for c in ("x0", "x1", "y0", "y1")])
    level = F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(1e-300)) / ACROSS)), F.ceil(F.log2(F.greatest(reach, F.lit(1e-300)))) - 50).cast("int")
    sized = boxed.where(F.col("x1").isNotNull() & F.col("y1").isNotNull() & (reach < float("inf"))).withColumn("level", level).withColumn("size", F.pow(F.lit(2.0), "level"))
    at = lambda c: F.floor(F.col(c) / F.col("size")).cast("long")
    cells = sized.withColumn("gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("gy", F.explode(F.sequence(at("y0"), at("y1"))))
    # an edge comes near a cell if their boxes meet
    low_x, low_y = F.col("gx") * F.col("size"), F.col("gy") * F.col("size")
    cells = cells.withColumns({"cx0": low_x, "cx1": low_x + F.col("size"), "cy0": low_y, "cy1": low_y + F.col("size")})
    near = F.expr(f"exists({_edges()}, e -> least(e.a.x, e.b.x) <= cx1 AND greatest(e.a.x, e.b.x) >= cx0 AND least(e.a.y, e.b.y) <= cy1 AND greatest(e.a.y, e.b.y) >= cy0)")
    cells = cells.withColumns({"mx": (F.col("cx0") + F.col("cx1")) / 2, "my": (F.col("cy0") + F.col("cy1")) / 2}).withColumn("edge", near)
    held = cells.where(F.col("edge") | inside("mx", "my"))
    return held.select("polygon_id", "ord", "ring", "level", "gx", "gy", (~F.col("edge")).alias("whole"))


def point_in_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(point_id, polygon_id): the first polygon, by ord, that holds a point; points in none are left out.

    points: (point_id, x, y); polygons: (polygon_id, ord, ring of corners). Points meet the cells of their own place at each
    size that any polygon has cells of; in cells at a polygon's edge a ray is cast. Points without coordinates, and
    polygons without corners, match nothing; of equal ord the least polygon.
    """
    cells = cover(polygons)
    levels = F.broadcast(cells.select("level").distinct().agg(F.collect_list("level").alias("levels")))
    at = points.where("x IS NOT NULL AND y IS NOT NULL").select("point_id", "x", "y").join(levels).select("point_id", "x", "y", F.explode("levels").alias("level"))
    place = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level")).cast("long")
    hits = at.withColumns({"gx": place("x"), "gy": place("y")}).join(cells, ["level", "gx", "gy"]).where(F.col("whole") | inside())
    return hits.groupBy("point_id").agg(F.min(F.struct("ord", "polygon_id")).alias("m")).select("point_id", "m.polygon_id")


def located(points: DataFrame, polygons: DataFrame, province: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with polygon_id and, where ``province`` names a column of numbers, province_code; one row with matched and unmatched).

    Points in no polygon are left out of the first, and counted in the second.
    """
    found = point_in_polygon(points, polygons)
    rows = points.join(found, "point_id", "left")
    counts = rows.agg(F.count("polygon_id").alias("matched"), F.count_if(F.col("polygon_id").isNull()).alias("unmatched"))
    out = rows.where("polygon_id IS NOT NULL")
    return (out.withColumn("province_code", province_code(province)) if province else out), counts
