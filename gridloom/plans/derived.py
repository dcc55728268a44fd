"""Queries whose listings, metadata texts, mappings, layers, boxes and grids are derived from the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions.expr import overlap_of, radial_weight, soft_weight
from gridloom.operators import drivers, geometry, normalize, tiles, training
from gridloom.operators import raster as ops
from gridloom.sources import mappings, scenes

from .classes import rounded
from .fixtures import R, WIDTH, height, raster, table
from .registry import query

# Fixed values of this fixture: band names of a listing (one unknown, one preview).
NAMES = ["B02", "B03", "B04", "B08", "B05", "B06", "B07", "B8A", "B11", "B12", "B01", "B09", "B10", "TCI", "B77"]

#: Every order is a file: a scene (of customer and priority) and a name in one of several layouts.  The text is SQL for both engines.
_SCENE = "concat('S2', CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END, '_MSIL1C_20240101T092401_N0510_R', CAST(o_custkey % 700 AS VARCHAR(9)), '_T34S', substr(o_orderpriority, 1, 1), 'H_20240101T000000')"
_BAND = "CASE (o_orderkey // 8) % 15 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(NAMES)) + " END"
_PATH = f"""CASE o_orderkey % 8 WHEN 0 THEN concat('/d/', {_SCENE}, '.zip')
WHEN 1 THEN concat('/d/', {_SCENE}, '.SAFE/GRANULE/g/IMG_DATA/R10m/T34SEH_20240101T092401_', {_BAND}, '_10m.jp2')
WHEN 2 THEN concat('/d/', {_SCENE}, '.SAFE/GRANULE/g/IMG_DATA/x_', {_BAND}, '.tif')
WHEN 3 THEN concat('/d/', {_SCENE}, '.SAFE/GRANULE/g/QI_DATA/', {_BAND}, '.jp2')
WHEN 4 THEN concat('/d/readme', CAST(o_orderkey AS VARCHAR(20)), '.txt')
ELSE concat('/d/', {_SCENE}, '.SAFE/GRANULE/g/IMG_DATA/T34SEH_20240101T092401_', {_BAND}, '.jp2') END"""
LISTED = f"f AS (SELECT {_PATH} AS path FROM orders), n AS (SELECT path, nullif(regexp_extract(path, '([^/]+?)[.](?:SAFE|zip)(?:/|$)', 1), '') AS scene FROM f)"
METRES = "m AS (SELECT unnest(['B02','B03','B04','B08','B05','B06','B07','B8A','B11','B12','B01','B09','B10']) AS band, unnest([10,10,10,10,20,20,20,20,20,20,60,60,60]) AS metres)"


def spark_sql(text: str):
    """An expression written for both engines: whole division is ``div`` here."""
    return F.expr(text.replace("//", "div"))


def listing(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(spark_sql(_PATH).alias("path"))


@query("scene_inventory", f"""WITH {LISTED} SELECT scene, split_part(scene, '_', 6) AS tile, bool_or(path LIKE '%.zip') AS is_archive, count_if(NOT path LIKE '%.zip') AS n_files,
bool_or(path LIKE '%.zip') AND count_if(NOT path LIKE '%.zip') = 0 AS needs_extract FROM n WHERE scene IS NOT NULL GROUP BY scene""")
def scene_inventory(spark, sf_dir):
    return scenes.inventory(listing(spark, sf_dir))


_BANDS = "SELECT scene, split_part(split_part(path, '_', -1), '.', 1) AS band, path FROM n WHERE path LIKE '%/IMG_DATA/%.jp2' AND NOT path LIKE '%TCI%'"


@query("band_inventory", f"WITH {LISTED}, {METRES}, b AS ({_BANDS}) SELECT scene, b.band, path, metres FROM b LEFT JOIN m ON b.band = m.band")
def band_inventory(spark, sf_dir):
    return scenes.bands(listing(spark, sf_dir))


@query("band_name_union", f"WITH {LISTED}, b AS ({_BANDS}) SELECT DISTINCT band FROM b")
def band_name_union(spark, sf_dir):
    return scenes.bands(listing(spark, sf_dir)).select("band").distinct()


_FOUND = """c AS (SELECT scene, band, path, CASE WHEN regexp_matches(path, '_' || band || '_[^/]*[.]jp2$') THEN 1 WHEN regexp_matches(path, '_' || band || '[.]jp2$') THEN 2
 WHEN regexp_matches(path, '_' || band || '_[^/]*[.]tif$') THEN 3 WHEN regexp_matches(path, '_' || band || '[.]tif$') THEN 4
 WHEN regexp_matches(path, band || '[^/]*[.]jp2$') THEN 5 WHEN regexp_matches(path, band || '[^/]*[.]tif$') THEN 6 END AS k FROM n, m WHERE contains(path, band)),
q AS (SELECT scene, band, path FROM (SELECT *, row_number() OVER (PARTITION BY scene, band ORDER BY k, path) AS r FROM c WHERE k IS NOT NULL) WHERE r = 1)"""


@query("find_bands", f"WITH {LISTED}, {METRES}, {_FOUND} SELECT * FROM q")
def find_bands(spark, sf_dir):
    return scenes.find_bands(listing(spark, sf_dir))


@query("missing_bands", f"WITH {LISTED}, {METRES}, {_FOUND} SELECT s.scene, m.band FROM (SELECT DISTINCT scene FROM n WHERE scene IS NOT NULL) s, m WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.scene = s.scene AND q.band = m.band)")
def missing_bands(spark, sf_dir):
    f = listing(spark, sf_dir)
    return scenes.missing_bands(scenes.find_bands(f).select("scene", "band"), scenes.inventory(f))


#: Every customer is a scene with metadata texts, a mask's share and, for even keys, a side-car line that names the next scene too.
_CLOUDS = """SELECT concat('S2A_', CAST(c_custkey AS VARCHAR(20))) AS scene,
CASE c_custkey % 5 WHEN 0 THEN concat('<a><n1:Cloud_Coverage_Assessment>', CAST(c_custkey % 90 AS VARCHAR(20)), '.5</n1:Cloud_Coverage_Assessment></a>') WHEN 1 THEN '<a>broken' END AS product_xml,
CASE c_custkey % 3 WHEN 0 THEN concat('<b><CLOUDY_PIXEL_PERCENTAGE>', CAST(c_custkey % 70 AS VARCHAR(20)), '</CLOUDY_PIXEL_PERCENTAGE></b>') WHEN 1 THEN '<c/>' END AS granule_xml,
CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 50 AS DOUBLE) + 25e-2 END AS mask_pct, c_custkey AS k FROM customer"""
_SIDE = "SELECT concat('see S2A_', CAST(k AS VARCHAR(20)), '.SAFE, S2A_', CAST(k + 1 AS VARCHAR(20))) AS name, CAST(k % 30 AS VARCHAR(20)) AS pct, k AS line FROM s WHERE k % 2 = 0"


@query("xml_cloud_priority", f"""WITH s AS ({_CLOUDS}), w AS (SELECT concat('S2A_', k) AS scene, k % 30 AS pct FROM s WHERE k % 2 = 0 UNION ALL SELECT concat('S2A_', k + 1), k % 30 FROM s WHERE k % 2 = 0),
c AS (SELECT s.scene, CASE WHEN k % 5 = 0 THEN k % 90 + 5e-1 END AS a, CASE WHEN k % 3 = 0 THEN CAST(k % 70 AS DOUBLE) END AS b, mask_pct, CAST(w.pct AS DOUBLE) AS d FROM s LEFT JOIN w ON w.scene = s.scene)
SELECT scene, coalesce(a, b, mask_pct, d, 10e0) AS cloud_pct, CASE WHEN a IS NOT NULL THEN 'product' WHEN b IS NOT NULL THEN 'granule' WHEN mask_pct IS NOT NULL THEN 'mask' WHEN d IS NOT NULL THEN 'sidecar' ELSE 'default' END AS source,
coalesce(a, b, mask_pct, d, 10e0) <= 10 AS valid FROM c""")
def xml_cloud_priority(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    s = spark.sql(f"{_CLOUDS.replace('FROM customer', 'FROM {customer}')}", customer=customer)
    side = spark.sql(_SIDE.replace("FROM s", "FROM {s}"), s=s)
    return scenes.usable(scenes.cloud_percentage(s.drop("k"), side))


#: Every part has a mapping file of one of the shapes; a and b are its two original classes.
_MAP = """CASE p_partkey % 5 WHEN 0 THEN concat('{"0": ', a, ', "1": ', b, ', "x": 3}') WHEN 1 THEN concat('{"class_mapping": {"', a, '": 0, "', b, '": 1, "900": 1}, "reverse_mapping": {"0": 99}}')
WHEN 2 THEN concat('{"reverse_mapping": {"0": ', a, ', "1": "', b, '"}}') WHEN 3 THEN concat('{"', a, '": 0, "', b, '": 1, "40": "two"}') ELSE '{"10": ' END"""
_MAP_PATH = "concat('/m/', CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_partkey % 5 = 0 THEN '/inverse_class_mapping.json' ELSE '/class_mapping.json' END)"
_PARTS = "SELECT p_partkey, CAST(p_size AS VARCHAR(20)) AS a, CAST(p_size + 100 AS VARCHAR(20)) AS b FROM part"


@query("json_mapping_load", f"""WITH q AS ({_PARTS}) SELECT {_MAP_PATH} AS path, CAST(CASE WHEN i = 0 THEN a WHEN p_partkey % 5 = 1 THEN '900' ELSE b END AS INT) AS orig, CAST(i AS INT) AS idx
FROM q, range(0, 2) t(i) WHERE p_partkey % 5 < 4""")
def json_mapping_load(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("a"), (F.col("p_size") + 100).cast("string").alias("b"))
    return mappings.parse(part.select(F.expr(_MAP_PATH).alias("path"), F.expr(_MAP).alias("json")))


_STORED = """CASE c_custkey % 3 WHEN 0 THEN concat('{"method": "custom", "rgb_mean": [1, 2, ', CAST(c_nationkey AS VARCHAR(9)), '], "rgb_std": [4, 5, 6], "other_mean": ', CAST(c_nationkey AS VARCHAR(9)), ', "other_std": 8, "raw_scale_factor": 1, "is_fitted": false}')
WHEN 1 THEN concat('{"method": "', c_mktsegment, '", "rgb_mean": [1, 2, 3], "other_std": ', CAST(c_nationkey AS VARCHAR(9)), '}') ELSE '{"method": ' END"""


@query("normalizer_load", """SELECT CAST(c_custkey AS VARCHAR) AS path, CASE c_custkey % 3 WHEN 0 THEN 'custom' WHEN 1 THEN c_mktsegment ELSE 'pretrained' END AS method,
CASE WHEN c_custkey % 3 = 0 THEN concat('1.0,2.0,', c_nationkey, '.0') ELSE '0.485,0.456,0.406' END AS rgb_mean, CASE WHEN c_custkey % 3 = 0 THEN '4.0,5.0,6.0' ELSE '0.229,0.224,0.225' END AS rgb_std,
CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS DOUBLE) ELSE 5e-1 END AS other_mean, CASE WHEN c_custkey % 3 = 0 THEN 8e0 ELSE 5e-1 END AS other_std,
CASE WHEN c_custkey % 3 = 0 THEN 1e0 ELSE 1e4 END AS raw_scale_factor, c_custkey % 3 <> 0 AS is_fitted FROM customer""")
def normalizer_load(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    n = mappings.normalizers(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.expr(_STORED).alias("json")))
    return n.select("path", "method", text("rgb_mean"), text("rgb_std"), "other_mean", "other_std", "raw_scale_factor", "is_fitted")


@query("mapping_precedence", "SELECT '/g/map.json' AS path, CAST(10 * max(n_nationkey) AS INT) AS orig, CAST(n_regionkey AS INT) AS idx FROM nation GROUP BY n_regionkey")
def mapping_precedence(spark, sf_dir):
    """A given mapping of nations to regions wins over a dataset's and over a checkpoint without a mapping."""
    pairs = F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit('"'), F.col("n_nationkey") * 10, F.lit('": '), F.col("n_regionkey")).alias("t"))))  # 25 nations
    given = table(spark, sf_dir, "nation").agg(F.concat(F.lit("{"), F.array_join(pairs["t"], ", "), F.lit("}")).alias("json"))
    three = F.array(
        F.struct(F.lit("given").alias("kind"), F.lit("/g/map.json").alias("path"), F.col("json")),
        F.struct(F.lit("dataset").alias("kind"), F.lit("/d/class_mapping.json").alias("path"), F.concat(F.lit('{"class_mapping": '), "json", F.lit("}")).alias("json")),
        F.struct(F.lit("checkpoint").alias("kind"), F.lit("/c/model.json").alias("path"), F.lit('{"epoch": 3}').alias("json")),
    )
    return mappings.precedence(given.select(F.explode(three).alias("f")).select("f.*"))


_LAYERS = "l AS (SELECT concat(p_brand, '-', p_size) AS model, p_partkey AS pos, 1 + 2 * (p_size % 4) AS kernel, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS stride FROM part)"


def _layers(spark, sf_dir):
    """Every part is a layer of the network of its brand and size."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat("p_brand", F.lit("-"), "p_size").alias("model"), F.col("p_partkey").alias("pos"), (1 + 2 * (F.col("p_size") % 4)).alias("kernel"), F.when(F.col("p_partkey") % 3 == 0, 2).otherwise(1).alias("stride"))


@query("receptive_field", f"""WITH {_LAYERS}, j AS (SELECT *, pow(2, count_if(stride = 2) OVER (PARTITION BY model ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS jump FROM l)
SELECT model, CAST(1 + sum((kernel - 1) * coalesce(jump, 1)) AS INT) AS rf, CAST(floor((1 + sum((kernel - 1) * coalesce(jump, 1))) * 2 / 3) AS INT) AS effective FROM j GROUP BY model""")
def receptive_field(spark, sf_dir):
    """As integers; null for a model whose field no INT holds."""
    f = training.receptive_field(_layers(spark, sf_dir))
    return f.select("model", *[F.col(c).try_cast("int").alias(c) for c in ("rf", "effective")])


@query("receptive_field_simple", f"WITH {_LAYERS} SELECT model, CAST(1 + sum((kernel - 1) * stride) AS INT) AS rf FROM l GROUP BY model")
def receptive_field_simple(spark, sf_dir):
    return training.receptive_field_simple(_layers(spark, sf_dir).withColumnRenamed("stride", "factor"))


@query("overlap_from_field", "SELECT p_partkey, CAST(CASE WHEN (p_partkey % 900) // 2 >= (p_size * 16) / 2e0 THEN (p_size * 16) // 4 ELSE (p_partkey % 900) // 2 END AS INT) AS overlap FROM part")
def overlap_from_field(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", overlap_of(F.col("p_partkey") % 900, F.col("p_size") * 16).alias("overlap"))


def _held(spark, sf_dir, windows, size):
    """Pixels and classes of R in each window."""
    w = windows.select("y0", "x0")
    return drivers.in_windows(raster(spark, sf_dir), w, size).groupBy("y0", "x0").agg(F.count("*").alias("n"), F.sum("cls").alias("classes"))


def _grid_sql(ys, xs):
    return f"""WITH {R}, g AS (SELECT DISTINCT CAST({ys} AS INT) AS y0, CAST({xs} AS INT) AS x0 FROM h, range(0, 10000) a(i), range(0, 4) b(i) WHERE {{where}})
SELECT y0, x0, count(*) AS n, CAST(sum(cls) AS BIGINT) AS classes FROM g JOIN r ON r.y >= y0 AND r.y < y0 + 32 AND r.x >= x0 AND r.x < x0 + 32 GROUP BY ALL"""


_FLOOR = "a.i * 24 + 32 <= h.h AND b.i * 24 + 32 <= 100"


@query("patch_grid_floor", _grid_sql("a.i * 24", "b.i * 24").format(where=_FLOOR))
def patch_grid_floor(spark, sf_dir):
    """Full windows of R alone, with their pixels; a raster lower than a window has none."""
    return _held(spark, sf_dir, tiles.grid_floor(spark, height(spark, sf_dir), WIDTH, 32, 8), 32)


@query("patch_grid_clamp", _grid_sql("least(a.i * 24, greatest(h.h - 32, 0))", "least(b.i * 24, 68)").format(where="a.i <= greatest(ceil((h.h - 32) / 24e0), 0)"))
def patch_grid_clamp(spark, sf_dir):
    """Windows that cover R, the last moved back inside."""
    return _held(spark, sf_dir, tiles.grid_clamp(spark, height(spark, sf_dir), WIDTH, 32, 8), 32)


@query("patch_names", f"""WITH {R}, g AS (SELECT CAST(a.i * 24 AS INT) AS y0, CAST(b.i * 24 AS INT) AS x0, row_number() OVER (ORDER BY a.i, b.i) - 1 AS k FROM h, range(0, 10000) a(i), range(0, 4) b(i) WHERE {_FLOOR})
SELECT y0, x0, CAST(k AS INT) AS patch_id, printf('patch_%05d', k) AS name FROM g""")
def patch_names(spark, sf_dir):
    return tiles.named(tiles.grid_floor(spark, height(spark, sf_dir), WIDTH, 32, 8))


@query("patch_grid_padded", f"""WITH {R}, g AS (SELECT a.i * 16 AS y0, b.i * 16 AS x0, c.i AS dy, d.i AS dx FROM h, range(0, 10000) a(i), range(0, 6) b(i), range(0, 32) c(i), range(0, 32) d(i) WHERE a.i < greatest(ceil((h.h - 16) / 16e0), 1)),
s AS (SELECT y0, x0, y0 + dy - 8 AS y, x0 + dx - 8 AS x FROM g), t AS (SELECT y0, x0, CASE WHEN y < 0 THEN -y - 1 WHEN y >= h THEN 2 * h - 1 - y ELSE y END AS y, CASE WHEN x < 0 THEN -x - 1 WHEN x >= 100 THEN 199 - x ELSE x END AS x FROM s, h)
SELECT CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0, count(*) AS n, CAST(sum(cls) AS BIGINT) AS classes FROM t JOIN r ON r.y = t.y AND r.x = t.x GROUP BY ALL""")
def patch_grid_padded(spark, sf_dir):
    """Windows of R padded by 8 on every side with its mirror image, with what they hold."""
    h = height(spark, sf_dir)
    held = tiles.in_padded(raster(spark, sf_dir).select("y", "x", "cls"), h, WIDTH, 32, 8)
    held = held.groupBy("y0", "x0").agg(F.count("*").alias("n"), F.sum("cls").alias("classes"))
    return tiles.grid_padded(spark, h, WIDTH, 32, 8).join(held, ["y0", "x0"])


@query("chunk_grid", f"""WITH {R}, g AS (SELECT a.i * 40 AS vy0, least(a.i * 40 + 40, h.h) AS vy1, b.i * 40 AS vx0, least(b.i * 40 + 40, 100) AS vx1, h.h FROM h, range(0, 10000) a(i), range(0, 3) b(i) WHERE a.i * 40 < h.h),
k AS (SELECT *, greatest(vy0 - 5, 0) AS y0, least(vy1 + 5, h) AS y1, greatest(vx0 - 5, 0) AS x0, least(vx1 + 5, 100) AS x1 FROM g)
SELECT CAST(vy0 AS INT) AS vy0, CAST(vx0 AS INT) AS vx0, count(*) AS n, count_if(y >= vy0 AND y < vy1 AND x >= vx0 AND x < vx1) AS own FROM k JOIN r ON r.y >= y0 AND r.y < y1 AND r.x >= x0 AND r.x < x1 GROUP BY ALL""")
def chunk_grid(spark, sf_dir):
    """Chunks of R with the pixels that they read and those that they own."""
    g = tiles.chunk_grid(spark, height(spark, sf_dir), WIDTH, 40, 5)
    held = tiles.in_chunks(raster(spark, sf_dir).select("y", "x"), g, 40, 5)
    return held.groupBy("vy0", "vx0").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))


_PLACED = "p AS (SELECT vec_id, CAST(unnest(range(0, 64)) // 8 AS INT) AS dy, CAST(unnest(range(0, 64)) % 8 AS INT) AS dx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE len(embedding) = 64)"


def _blended(spark, sf_dir, weight):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    w = weight(F.floor(F.col("pos") / 8), F.col("pos") % 8, 8)
    return rounded(e.groupBy("vec_id").agg(F.sum(w * F.col("v").cast("double")).alias("blended"), F.sum(w).alias("weight")))


@query("blend_weights_radial", f"WITH {_PLACED}, w AS (SELECT *, greatest(2e-1, least(1e0, 1 - sqrt(pow(dy * (2e0 / 7) - 1, 2) + pow(dx * (2e0 / 7) - 1, 2)))) AS w FROM p) SELECT vec_id, round(sum(w * v), 6) AS blended, round(sum(w), 6) AS weight FROM w GROUP BY vec_id")
def blend_weights_radial(spark, sf_dir):
    """The vectors as patches of 8 x 8, summed by the radial weights."""
    return _blended(spark, sf_dir, radial_weight)


@query("blend_weights_soft", f"WITH {_PLACED}, w AS (SELECT *, greatest(4e-1, least(1e0, 1 - 5e-1 * sqrt(pow((dy - 4e0) / 4, 2) + pow((dx - 4e0) / 4, 2)))) AS w FROM p) SELECT vec_id, round(sum(w * v), 6) AS blended, round(sum(w), 6) AS weight FROM w GROUP BY vec_id")
def blend_weights_soft(spark, sf_dir):
    return _blended(spark, sf_dir, soft_weight)


@query("constant_raster", f"WITH {R} SELECT y, x, CASE WHEN valid THEN cls ELSE 7 END AS cls FROM r")
def constant_raster(spark, sf_dir):
    """A constant raster of R's size under its valid pixels."""
    top = raster(spark, sf_dir).filter("valid").select("y", "x", F.col("cls").alias("_c"))
    return ops.constant(spark, height(spark, sf_dir), WIDTH, 7).join(top, ["y", "x"], "left").select("y", "x", F.coalesce("_c", "cls").alias("cls"))


_TAGGED = "z AS (SELECT p_partkey AS raster_id, CAST(unnest([0, 1]) AS INT) AS pos, unnest(['B02', 'B03']) AS band, unnest([p_retailprice, CAST(p_size AS DOUBLE)]) AS mean, unnest([p_size / 4e0, 5e-1]) AS std FROM part)"


def _tags(spark, sf_dir):
    """Every part is a raster with statistics in its tags."""
    text = lambda *c: F.concat_ws(",", *[v.cast("string") for v in c])
    p = table(spark, sf_dir, "part")
    mean, std = text(F.col("p_retailprice"), F.col("p_size")), text(F.col("p_size") / 4, F.lit(0.5))
    return p.select(F.col("p_partkey").alias("raster_id"), F.create_map(F.lit("band_names"), F.lit("B02,B03"), F.lit("STATISTICS_MEAN"), mean, F.lit("STATISTICS_STDDEV"), std).alias("tags"))


@query("norm_from_tags", f"WITH {_TAGGED} SELECT raster_id, pos, band, mean - 3 * std AS lo, mean + 3 * std AS hi FROM z")
def norm_from_tags(spark, sf_dir):
    return normalize.fit_from_tags(_tags(spark, sf_dir), "min_max")


@query("norm_from_tags_standard", f"WITH {_TAGGED} SELECT raster_id, pos, band, mean, std FROM z")
def norm_from_tags_standard(spark, sf_dir):
    return normalize.fit_from_tags(_tags(spark, sf_dir), "standard")


@query("geometry_coverage", """WITH b AS (SELECT c_custkey % 97 AS l, c_custkey % 89 AS b, c_custkey % 97 + 1 + c_nationkey % 3 AS r, c_custkey % 89 + 1 + c_custkey % 2 AS t FROM customer WHERE c_acctbal < 0),
c AS (SELECT i, j, EXISTS (SELECT 1 FROM b WHERE l <= i AND i < r AND b <= j AND j < t) AS hit FROM range(0, 80) x(i), range(0, 90) y(j))
SELECT 7200e0 AS area, CAST(count_if(hit) AS DOUBLE) AS covered, CAST(count_if(NOT hit) AS DOUBLE) AS missing, round(100e0 * count_if(hit) / 7200, 6) AS share FROM c""")
def geometry_coverage(spark, sf_dir):
    """Customers in debt are boxes on a field of 80 x 90; how much of it they cover."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0")
    left, bottom = F.col("c_custkey") % 97, F.col("c_custkey") % 89
    box = [left, bottom, left + 1 + F.col("c_nationkey") % 3, bottom + 1 + F.col("c_custkey") % 2]
    boxes = c.select(*[v.cast("double").alias(n) for v, n in zip(box, ("left", "bottom", "right", "top"))])
    return geometry.coverage(boxes, (0, 0, 80, 90)).withColumn("share", F.round("share", 6))


@query("polygon_coverage", """WITH k AS (SELECT DISTINCT c_custkey % 97 AS x, c_custkey % 89 AS y FROM customer WHERE c_acctbal < 5e3),
g AS (SELECT i, j, EXISTS (SELECT 1 FROM k WHERE x = i AND y = j) AS a, EXISTS (SELECT 1 FROM k WHERE x = i + 1 AND y = j) AS b, EXISTS (SELECT 1 FROM k WHERE x = i AND y = j + 1) AS c, EXISTS (SELECT 1 FROM k WHERE x = i + 1 AND y = j + 1) AS d FROM range(2, 82) t(i), range(3, 73) u(j)),
s AS (SELECT sum(CAST(a OR b AS INT) + CAST(c OR d AS INT) + CAST(a OR c AS INT) + CAST(b OR d AS INT)) / 4e0 AS covered FROM g)
SELECT 5600e0 AS area, round(covered, 6) AS covered, round(5600 - covered, 6) AS missing, round(100 * covered / 5600, 6) AS share FROM s""")
def polygon_coverage(spark, sf_dir):
    """Squares on their corners around places of customers; how much of a field they cover, overlaps counted once."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 5e3")
    side = F.lit(2**0.5)
    ring = geometry.turned_box((F.col("c_custkey") % 97).cast("double"), (F.col("c_custkey") % 89).cast("double"), side, side, F.lit(math.pi / 4))
    return rounded(geometry.polygon_coverage(c.select(ring.alias("ring")), [(2, 3), (82, 3), (82, 73), (2, 73)]))
