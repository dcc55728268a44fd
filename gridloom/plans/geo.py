"""Queries between coordinate systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import warp
from gridloom.operators.warp import BACK, FALSE_EASTING, FORTH, SCALE, rectifying_radius, series

from .files import ORIGIN, STEP
from .fixtures import R, WIDTH, height, raster
from .registry import query

#: A grid of the zone to the east around R, whose 10 m pixels are turned by the meridians' convergence; 20 rows more than R has.
EAST = ("EPSG:32635", -28_400.0, 4_217_100.0)
MORE, ACROSS = 20, 220


def grids(spark, sf_dir):
    h = height(spark, sf_dir)
    return warp.Grid(h, WIDTH, "EPSG:32634", *ORIGIN, *STEP), warp.Grid(h + MORE, ACROSS, *EAST, *STEP)


def _waves(table, sign, a, b):
    """u and v: a series of the transverse Mercator projection, in SQL."""
    c = series(table)
    u = " ".join(f"{sign} {k!r} * sin({2 * i} * {a}) * cosh({2 * i} * {b})" for i, k in enumerate(c, 1))
    v = " ".join(f"{sign} {k!r} * cos({2 * i} * {a}) * sinh({2 * i} * {b})" for i, k in enumerate(c, 1))
    return f"{a} {u} AS u, {b} {v} AS v"


_RADIUS = repr(SCALE * rectifying_radius())

#: Places in R of the pixels of the eastern grid: back from zone 35 to the conformal latitude and the longitude, forth to zone 34.
PLACES = f"""g AS (SELECT CAST(i AS INT) AS y, CAST(j AS INT) AS x FROM h, range(0, h.h + {MORE}) a(i), range(0, {ACROSS}) b(j)),
p1 AS (SELECT y, x, ({EAST[2]!r} - 10 * (y + 5e-1)) / {_RADIUS} AS s, ({EAST[1]!r} + 10 * (x + 5e-1) - {FALSE_EASTING!r}) / {_RADIUS} AS e FROM g),
p2 AS (SELECT y, x, {_waves(BACK, '-', 's', 'e')} FROM p1),
p3 AS (SELECT y, x, sin(u) / sqrt(sinh(v) * sinh(v) + cos(u) * cos(u)) AS t, atan2(sinh(v), cos(u)) + radians(6) AS w FROM p2),
p4 AS (SELECT y, x, atan2(t, cos(w)) AS s, asinh(sin(w) / sqrt(t * t + cos(w) * cos(w))) AS e FROM p3),
p5 AS (SELECT y, x, {_waves(FORTH, '+', 's', 'e')} FROM p4),
p AS (SELECT y, x, ({_RADIUS} * u - {ORIGIN[1]!r}) / -10 - 5e-1 AS r, ({FALSE_EASTING!r} + {_RADIUS} * v - {ORIGIN[0]!r}) / 10 - 5e-1 AS c FROM p5)"""


@query("warp_zone_bilinear", f"""WITH {R}, {PLACES},
q AS (SELECT p.y, p.x, r.price, (1 - abs(p.r - floor(p.r) - a.d)) * (1 - abs(p.c - floor(p.c) - b.d)) AS w
  FROM p, h, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d), r
  WHERE p.r >= -5e-1 AND p.r < h.h - 5e-1 AND p.c >= -5e-1 AND p.c < 995e-1 AND r.y = CAST(floor(p.r) AS INT) + a.d AND r.x = CAST(floor(p.c) AS INT) + b.d AND r.valid)
SELECT 'price' AS band, y, x, round(sum(w * price) / sum(w), 3) AS value FROM q WHERE w > 0 GROUP BY y, x""")
def warp_zone_bilinear(spark, sf_dir):
    """Prices of R, without those where status is P, on a grid of the next zone."""
    r = raster(spark, sf_dir).filter("valid").select(F.lit("price").alias("band"), "y", "x", F.col("price").alias("value"))
    source, target = grids(spark, sf_dir)
    return warp.warp(r, source, target, block=64).withColumn("value", F.round("value", 3))


@query("warp_zone_nearest", f"""WITH {R}, {PLACES}
SELECT p.y, p.x, CAST(r.cls AS DOUBLE) AS value FROM p, r WHERE r.y = CAST(floor(p.r + 5e-1) AS INT) AND r.x = CAST(floor(p.c + 5e-1) AS INT)""")
def warp_zone_nearest(spark, sf_dir):
    """Classes of R on a grid of the next zone."""
    r = raster(spark, sf_dir).select("y", "x", F.col("cls").alias("value"))
    source, target = grids(spark, sf_dir)
    return warp.warp(r, source, target, method="nearest", keys=(), block=64)
