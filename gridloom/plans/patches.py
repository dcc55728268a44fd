"""Queries: patch grids, membership, splits and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.expr import radial_weight
from gridloom.operators import merge, split, tiles

from .classes import GRID, IN, rounded
from .fixtures import L, R, WIDTH, height, patch_labels, raster, table
from .registry import query


def _cover(spark, sf_dir):
    return tiles.cover(raster(spark, sf_dir), height(spark, sf_dir), WIDTH, 32, 8)


@query("patch_cover", f"WITH {R}, {GRID} SELECT y0, x0, count(*) AS n, CAST(sum(r.y - y0) AS BIGINT) AS dy, CAST(sum(r.x - x0) AS BIGINT) AS dx FROM r JOIN g ON {IN} GROUP BY y0, x0")
def patch_cover(spark, sf_dir):
    return _cover(spark, sf_dir).groupBy("y0", "x0").agg(F.count("*").alias("n"), F.sum("dy").alias("dy"), F.sum("dx").alias("dx"))


@query("patch_cover_floor", f"""WITH {R}, g AS (SELECT a.i * 24 AS y0, b.i * 24 AS x0 FROM h, range(0, 100000) a(i), range(0, 3) b(i) WHERE a.i * 24 + 32 <= h.h)
SELECT y0, x0, count(*) AS n FROM r JOIN g ON {IN} GROUP BY y0, x0""")
def patch_cover_floor(spark, sf_dir):
    return tiles.cover(raster(spark, sf_dir), height(spark, sf_dir), WIDTH, 32, 8, clamp=False).groupBy("y0", "x0").agg(F.count("*").alias("n"))


@query("patch_majority", f"""WITH {R}, {GRID}, c AS (SELECT y0, x0, cls, count(*) AS n FROM r JOIN g ON {IN} GROUP BY 1, 2, 3)
SELECT y0, x0, cls AS major, n AS n_major FROM (SELECT *, row_number() OVER (PARTITION BY y0, x0 ORDER BY n DESC, cls) AS k FROM c) WHERE k = 1""")
def patch_majority(spark, sf_dir):
    return tiles.majority(_cover(spark, sf_dir), ["y0", "x0"])


@query("patch_valid_filter", f"""WITH {R}, {GRID}, v AS (SELECT y, x, bits % 10 <> 0 AND NOT (2 * y >= h.h AND x < 50) AS ok FROM r, h)
SELECT y0, x0, round(avg(CAST(ok AS INT)), 6) AS fraction FROM v AS r JOIN g ON {IN} GROUP BY 1, 2 HAVING avg(CAST(ok AS INT)) >= 7e-1""")
def patch_valid_filter(spark, sf_dir):
    h = height(spark, sf_dir)  # the lower left quarter is invalid, so patches fall on both sides of 0.7
    ok = (F.col("bits") % 10 != 0) & ~((2 * F.col("y") >= h) & (F.col("x") < 50))
    return rounded(tiles.keep_valid(tiles.valid_fraction(_cover(spark, sf_dir).withColumn("valid", ok), ["y0", "x0"])))


@query("rare_patches", f"WITH {R}, {GRID} SELECT y0, x0, string_agg(DISTINCT CAST(cls AS VARCHAR), ',' ORDER BY CAST(cls AS VARCHAR)) AS classes FROM r JOIN g ON {IN} WHERE cls IN (10, 50) GROUP BY 1, 2")
def rare_patches(spark, sf_dir):
    return tiles.rare_patches(_cover(spark, sf_dir), [10, 50], ["y0", "x0"]).withColumn("classes", F.array_join(F.transform("classes", lambda c: c.cast("string")), ","))


RARE = f"""{R}, w AS (SELECT y, x, row_number() OVER (PARTITION BY cls ORDER BY md5(CAST(pixel_id AS VARCHAR)), pixel_id) AS k FROM r WHERE cls IN (10, 50)),
rw AS (SELECT DISTINCT CAST(greatest(0, least(y - 16, h.h - 32)) AS INT) AS y0, CAST(greatest(0, least(x - 16, 68)) AS INT) AS x0 FROM w, h WHERE k <= 30)"""


@query("rare_windows", f"WITH {RARE} SELECT y0, x0 FROM rw")
def rare_windows(spark, sf_dir):
    return tiles.rare_windows(raster(spark, sf_dir), [10, 50], height(spark, sf_dir), WIDTH, 32)


@query("add_rare_windows", f"WITH {RARE}, {GRID} SELECT y0, x0 FROM g UNION SELECT y0, x0 FROM rw")
def add_rare_windows(spark, sf_dir):
    return tiles.add_patches(tiles.grid_clamp(spark, height(spark, sf_dir), WIDTH, 32, 8), rare_windows(spark, sf_dir))


@query("pixel_centred_window", f"""WITH {R}, c AS (SELECT y AS cy, x AS cx FROM r WHERE valid), o AS (SELECT CAST(a.i AS INT) AS dy, CAST(b.i AS INT) AS dx FROM range(0, 5) a(i), range(0, 5) b(i))
SELECT cy, cx, dy, dx, coalesce(r.cls, 0) AS cls FROM c CROSS JOIN o LEFT JOIN r ON r.y = cy + dy - 2 AND r.x = cx + dx - 2""")
def pixel_centred_window(spark, sf_dir):
    r = raster(spark, sf_dir)
    return tiles.centred_window(r, r.filter("valid"), 5, "cls")


def strat(cls: str, src: str) -> str:
    return f"""o AS (SELECT patch_id, {cls} AS cls, row_number() OVER (PARTITION BY {cls} ORDER BY md5(CAST(patch_id AS VARCHAR)), patch_id) AS r, count(*) OVER (PARTITION BY {cls}) AS n FROM {src})"""


CUT = "t AS (SELECT *, CAST(ceil(round(n * 15e-2, 9)) AS INT) AS nt FROM o), s AS (SELECT *, CAST(ceil(round((n - nt) * (15e-2 / 85e-2), 9)) AS INT) AS nv FROM t)"
PICK = "CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'val' ELSE 'train' END"


@query("split_stratified", f"WITH {L}, {strat('cls', 'l')}, {CUT} SELECT patch_id, cls, {PICK} AS split FROM s")
def split_stratified(spark, sf_dir):
    return split.stratified_split(patch_labels(spark, sf_dir).select("patch_id", "cls"), "patch_id")


@query("split_rare_branch", f"""WITH {L}, {strat('rare_cls', 'l')}, s AS (SELECT *, CAST(greatest(1, floor(round(n * 15e-2, 9))) AS INT) AS k FROM o)
SELECT patch_id, cls, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN r = 1 THEN 'train' ELSE 'val' END WHEN r <= k THEN 'test' WHEN r <= 2 * k THEN 'val' ELSE 'train' END AS split FROM s""")
def split_rare_branch(spark, sf_dir):
    return split.stratified_split(patch_labels(spark, sf_dir).select("patch_id", F.col("rare_cls").alias("cls")), "patch_id", rare=True)


@query("split_random", f"WITH o AS (SELECT vec_id AS patch_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r, count(*) OVER () AS n FROM embeddings), {CUT} SELECT patch_id, {PICK} AS split FROM s")
def split_random(spark, sf_dir):
    return split.random_split(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id")), "patch_id")


@query("split_report", f"WITH {L}, {strat('cls', 'l')}, {CUT} SELECT cls, count_if({PICK} = 'train') AS train, count_if({PICK} = 'val') AS val, count_if({PICK} = 'test') AS test FROM s GROUP BY cls")
def split_report(spark, sf_dir):
    return split.report(split_stratified(spark, sf_dir))


W = "greatest(2e-1, least(1e0, 1 - sqrt(pow((r.y - y0) * (2e0 / 31) - 1, 2) + pow((r.x - x0) * (2e0 / 31) - 1, 2))))"
PROBS = f"""{R}, {GRID}, pr AS (SELECT r.y, r.x, k.k AS cls, ((r.pixel_id * 7 + y0 * 3 + x0 * 5 + k.k * 11) % 97) / 97e0 AS p, {W} AS w FROM r JOIN g ON {IN} CROSS JOIN (VALUES (0), (1), (2)) k(k)),
mg AS (SELECT y, x, cls, sum(p * w) / sum(w) AS p FROM pr GROUP BY 1, 2, 3)"""


def _probs(spark, sf_dir):
    c = _cover(spark, sf_dir).withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    p = F.pmod(F.col("pixel_id") * 7 + F.col("y0") * 3 + F.col("x0") * 5 + F.col("cls") * 11, F.lit(97)) / F.lit(97e0)
    return c.select("y", "x", "cls", p.alias("p"), radial_weight(F.col("dy"), F.col("dx"), 32).alias("w"))


@query("merge_weighted", f"WITH {PROBS} SELECT y, x, cls, round(p, 6) AS p FROM mg")
def merge_weighted(spark, sf_dir):
    return rounded(merge.weighted(_probs(spark, sf_dir)))


@query("merge_argmax", f"WITH {PROBS} SELECT y, x, cls FROM (SELECT y, x, cls, row_number() OVER (PARTITION BY y, x ORDER BY round(p, 9) DESC, cls) AS k FROM mg) WHERE k = 1")
def merge_argmax(spark, sf_dir):
    return merge.argmax(merge.weighted(_probs(spark, sf_dir))).select("y", "x", "cls")


@query("merge_naive", f"WITH {R}, {GRID} SELECT r.y, r.x, CAST(sum((r.pred + y0) % 6) // count(*) AS INT) AS cls FROM r JOIN g ON {IN} GROUP BY 1, 2")
def merge_naive(spark, sf_dir):
    return merge.naive(_cover(spark, sf_dir).select("y", "x", ((F.col("pred") + F.col("y0")) % 6).alias("cls")))
