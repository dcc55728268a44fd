"""Queries: raster algebra, neighbourhoods, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.expr import cloud_bits
from gridloom.operators import classes, focal, raster as ops

from .classes import rounded
from .fixtures import R, TILES, WIDTH, height, raster, tiles
from .registry import query


@query("validity_mask", f"WITH {R} SELECT y, x, NOT (price = 0 OR cust = 0 OR pred = 0) AND (bits >> 10) & 1 = 0 AND (bits >> 11) & 1 = 0 AS valid FROM r")
def validity_mask(spark, sf_dir):
    bands = F.array("price", "cust", F.col("pred").cast("double"))
    return ops.validity(raster(spark, sf_dir), bands, cloud=F.col("bits")).select("y", "x", "valid")


def _merge(rule):
    def run(spark, sf_dir):
        return ops.merge_validity(tiles(spark, sf_dir).select("y", "x", "priority", "valid"), rule)

    return run


for _rule, _sql in {"first": "arg_min(valid, priority)", "all": "bool_and(valid)", "any": "bool_or(valid)"}.items():
    query(f"validity_merge_{_rule}", f"WITH {TILES} SELECT y, x, {_sql} AS valid FROM t GROUP BY y, x")(_merge(_rule))


@query("valid_pixel_report", f"WITH {TILES} SELECT priority, count_if(valid) AS n_valid, count(*) AS n, round(100e0 * count_if(valid) / count(*), 6) AS pct FROM t GROUP BY priority")
def valid_pixel_report(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return rounded(t.groupBy("priority").agg(F.count_if("valid").alias("n_valid"), F.count("*").alias("n"), (F.count_if("valid") * 100e0 / F.count("*")).alias("pct")))


@query("mosaic_first", f"WITH {TILES} SELECT y, x, arg_min(value, priority) FILTER (WHERE value IS NOT NULL) AS value FROM t GROUP BY y, x")
def mosaic_first(spark, sf_dir):
    return ops.mosaic(tiles(spark, sf_dir))


@query("crop_bounds", f"WITH {R} SELECT y - 3 AS y, x - 10 AS x, cls FROM r WHERE y >= 3 AND y < 9 AND x >= 10 AND x < 40")
def crop_bounds(spark, sf_dir):
    return ops.crop(raster(spark, sf_dir).select("y", "x", "cls"), 3, 9, 10, 40)


@query("band_stack", f"WITH {R} SELECT y, x, cust AS b0, price AS b1 FROM r")
def band_stack(spark, sf_dir):
    from gridloom.operators.stats import long_bands

    s = ops.stack(long_bands(raster(spark, sf_dir), {"price": "price", "cust": "cust"}), ["price", "cust"])
    return s.select("y", "x", F.col("bands")[0].alias("b0"), F.col("bands")[1].alias("b1"))


@query("cloud_bits", f"WITH {R} SELECT y, x, (bits >> 10) & 1 = 1 AS opaque, (bits >> 11) & 1 = 1 AS cirrus, bits & 8 <> 0 AS cloud8 FROM r")
def cloud_bits_query(spark, sf_dir):
    b = cloud_bits(F.col("bits"))
    return raster(spark, sf_dir).select("y", "x", *[c.alias(n) for n, c in b.items()])


@query("cloud_pct", f"WITH {R} SELECT y % 5 AS tile, round(100e0 * avg(CAST(bits & 8 <> 0 AS INT)), 6) AS cloud_pct FROM r GROUP BY 1")
def cloud_pct(spark, sf_dir):
    return rounded(ops.cloud_share(raster(spark, sf_dir).withColumn("tile", F.col("y") % 5), "bits", ["tile"]))


@query("brovey", f"WITH {R}, m AS (SELECT avg((price + cust + pred) / 3) AS m, min(cust) AS lo, max(cust) AS hi FROM r) SELECT y, x, round(greatest(lo, least(hi, cust * ((price + cust + pred) / 3) / greatest(m, 1e-6))), 4) AS sharp FROM r, m")
def brovey(spark, sf_dir):
    i = (F.col("price") + F.col("cust") + F.col("pred")) / 3
    return ops.SHARPEN["brovey"](raster(spark, sf_dir), "cust", i).select("y", "x", F.round("sharp", 4).alias("sharp"))


@query("nearest_downsample", f"WITH {R}, o AS (SELECT CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x FROM h, range(0, 100000) a(i), range(0, 25) b(i) WHERE a.i < h.h // 3) SELECT o.y, o.x, r.cls FROM o, h, r WHERE r.y = CAST(floor((o.y + 5e-1) * h.h / (h.h // 3)) AS INT) AND r.x = CAST(floor((o.x + 5e-1) * 100 / 25) AS INT)")
def nearest_downsample(spark, sf_dir):
    h = height(spark, sf_dir)
    return ops.nearest(raster(spark, sf_dir).select("y", "x", "cls"), h, WIDTH, h // 3, 25)


@query("stride_subsample", f"WITH {R} SELECT CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, cls FROM r WHERE y % 3 = 0 AND x % 3 = 0")
def stride_subsample(spark, sf_dir):
    return ops.subsample(raster(spark, sf_dir).select("y", "x", "cls"), 3)


BIL = f"""{R}, o AS (SELECT CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, greatest(0e0, least(h.h - 1e0, (a.i + 5e-1) * (h.h / CAST(h.h // 2 AS DOUBLE)) - 5e-1)) AS fy, greatest(0e0, least(99e0, (b.i + 5e-1) * (100 / 60e0) - 5e-1)) AS fx
 FROM h, range(0, 100000) a(i), range(0, 60) b(i) WHERE a.i < h.h // 2),
k AS (SELECT o.y, o.x, least(floor(fy) + dy, h.h - 1) AS sy, least(floor(fx) + dx, 99) AS sx, (CASE dy WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE dx WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS w
 FROM o, h, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx))"""


@query("bilinear_align", f"WITH {BIL} SELECT k.y, k.x, round(sum(w * r.cust) / sum(w), 4) AS cust FROM k JOIN r ON r.y = k.sy AND r.x = k.sx WHERE w > 0 GROUP BY 1, 2")
def bilinear_align(spark, sf_dir):
    h = height(spark, sf_dir)
    return rounded(ops.bilinear(raster(spark, sf_dir), "cust", h, WIDTH, h // 2, 60), 4)


@query("cubic_resize", None)
def cubic_resize(spark, sf_dir):
    h = height(spark, sf_dir)
    return rounded(ops.cubic(raster(spark, sf_dir), "cust", h, WIDTH, h // 2, 60), 4)


for _how, (_y, _x) in {"h": ("y", "99 - x"), "v": ("h.h - 1 - y", "x"), "r90": ("99 - x", "y"), "t": ("x", "y")}.items():

    def _flip(spark, sf_dir, how=_how):
        return ops.flip(raster(spark, sf_dir).select("y", "x", "cls"), height(spark, sf_dir), WIDTH, how).select("y", "x", "cls")

    query(f"flip_{_how}", f"WITH {R} SELECT CAST({_y} AS INT) AS y, CAST({_x} AS INT) AS x, cls FROM r, h")(_flip)


@query("paste_objects", f"""WITH {R}, o AS (SELECT y + 2 AS y, x + 3 AS x, price AS v, cls AS c FROM r WHERE y < 3 AND x < 4)
SELECT r.y, r.x, round(CASE WHEN o.v IS NULL THEN r.price ELSE o.v * 6e-1 + r.price * (1 - 6e-1) END, 4) AS value, coalesce(o.c, r.cls) AS cls FROM r LEFT JOIN o ON r.y = o.y AND r.x = o.x""")
def paste_objects(spark, sf_dir):
    r = raster(spark, sf_dir).select("y", "x", F.col("price").alias("value"), "cls")
    return rounded(ops.paste(r, r.filter("y < 3 and x < 4"), 2, 3, 0.6), 4)


def box(r: int, border: str) -> str:
    fold = {
        "reflect": "CASE WHEN {v} < 0 THEN -{v} - 1 WHEN {v} >= {n} THEN 2 * {n} - 1 - {v} ELSE {v} END",
        "clamp": "greatest(0, least({v}, {n} - 1))",
    }[border]
    y, x = fold.format(v="(a.y + d.dy)", n="h.h"), fold.format(v="(a.x + d.dx)", n="100")
    return f"d AS (SELECT p.i AS dy, q.i AS dx FROM range({-r}, {r + 1}) p(i), range({-r}, {r + 1}) q(i)), nb AS (SELECT a.y, a.x, {y} AS sy, {x} AS sx FROM r a, d, h)"


TOP = "SELECT y, x, cls FROM (SELECT y, x, cls, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, cls) AS k FROM (SELECT nb.y, nb.x, r.cls, count(*) AS n FROM nb JOIN r ON r.y = nb.sy AND r.x = nb.sx GROUP BY 1, 2, 3)) WHERE k = 1"


@query("mean_filter_argmax", f"WITH {R}, {box(3, 'reflect')} {TOP}")
def mean_filter_argmax(spark, sf_dir):
    return focal.mean_filter_argmax(raster(spark, sf_dir), height(spark, sf_dir), WIDTH, 7)


@query("majority_3x3", f"WITH {R}, {box(1, 'clamp')} {TOP}")
def majority_3x3(spark, sf_dir):
    return focal.majority_filter(raster(spark, sf_dir), height(spark, sf_dir), WIDTH, 3)


@query("smooth_two_stage", f"WITH {R.replace('r AS', 'r0 AS', 1).replace('FROM r)', 'FROM r0)')}, {box(3, 'reflect').replace('FROM r a', 'FROM r0 a')}, r AS ({TOP.replace('JOIN r ON', 'JOIN r0 r ON')}), {box(1, 'clamp').replace('d AS', 'd2 AS', 1).replace(', d, h', ', d2 d, h').replace('nb AS', 'nb2 AS', 1)} {TOP.replace('FROM nb JOIN', 'FROM nb2 nb JOIN')}")
def smooth_two_stage(spark, sf_dir):
    return focal.smooth(raster(spark, sf_dir), height(spark, sf_dir), WIDTH)


@query("highpass_3x3", f"WITH {R}, {box(1, 'reflect')}, s AS (SELECT nb.y, nb.x, sum(r.cust) AS s FROM nb JOIN r ON r.y = nb.sy AND r.x = nb.sx GROUP BY 1, 2) SELECT r.y, r.x, round((10 * r.cust - s.s) / 9, 4) AS cust FROM r JOIN s USING (y, x)")
def highpass_3x3(spark, sf_dir):
    return rounded(focal.high_pass(raster(spark, sf_dir), height(spark, sf_dir), WIDTH, "cust"), 4)


def _two_class(spark, sf_dir):
    return raster(spark, sf_dir).select("y", "x", F.when(F.col("pred") < 3, 1).otherwise(2).alias("cls"))


@query("components_4", None)
def components_4(spark, sf_dir):
    return focal.components(_two_class(spark, sf_dir))


@query("components_8_bbox", None)
def components_8_bbox(spark, sf_dir):
    r = raster(spark, sf_dir).select("y", "x", F.when(F.col("pred") == 0, 1).otherwise(0).alias("cls"))
    return focal.objects(r, 3, 200)


@query("small_object_removal", None)
def small_object_removal(spark, sf_dir):
    return focal.remove_small(_two_class(spark, sf_dir), 20)


@query("gap_fill", f"""WITH {R}, z AS (SELECT y, x, CASE WHEN pred = 0 THEN 0 ELSE cls END AS cls FROM r), d AS (SELECT p.i AS dy, q.i AS dx FROM range(-3, 4) p(i), range(-3, 4) q(i)),
n AS (SELECT a.y, a.x, b.cls, count(*) AS n FROM z a, d, z b WHERE a.cls = 0 AND b.cls <> 0 AND b.y = a.y + d.dy AND b.x = a.x + d.dx GROUP BY 1, 2, 3),
f AS (SELECT y, x, cls FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, cls) AS k FROM n) WHERE k = 1)
SELECT z.y, z.x, coalesce(f.cls, z.cls) AS cls FROM z LEFT JOIN f ON z.y = f.y AND z.x = f.x""")
def gap_fill(spark, sf_dir):
    r = raster(spark, sf_dir).select("y", "x", F.when(F.col("pred") == 0, 0).otherwise(F.col("cls")).alias("cls"))
    return focal.fill_gaps(r, height(spark, sf_dir), WIDTH)


@query("post_process_chain", None)
def post_process_chain(spark, sf_dir):
    r = raster(spark, sf_dir)
    mapped = classes.remap(r, classes.invert(classes.dense_mapping(r)), "pred", "cls").select("y", "x", "cls")
    return focal.post_process(mapped, height(spark, sf_dir), WIDTH)
