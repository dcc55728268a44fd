"""Queries: scene alignment and merging, prediction with a scorer, stored normalizers and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import drivers, normalize, scene, scoring
from gridloom.sources import blocks

from .classes import rounded
from .fixtures import R, TILES, WIDTH, height, literal, raster, table, tiles
from .registry import query
from .training import drawn


@query("align_to_truth", f"""WITH {R} SELECT 'a' AS tile, 'price' AS band, CAST(r.y - a.d AS INT) AS y, CAST(r.x - b.d AS INT) AS x, round(avg(price), 6) AS value FROM r, h, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d)
WHERE r.y - a.d BETWEEN 0 AND h.h - 2 AND r.x - b.d BETWEEN 0 AND 98 GROUP BY ALL""")
def align_to_truth(spark, sf_dir):
    """R on a grid half a pixel further."""
    h = height(spark, sf_dir)
    long = raster(spark, sf_dir).select(F.lit("a").alias("tile"), F.lit("price").alias("band"), "y", "x", F.col("price").alias("value"))
    meta = blocks.metadata(spark, h, WIDTH, step=(1.0, 1.0)).withColumn("tile", F.lit("a"))
    return rounded(scene.align(long, meta, blocks.metadata(spark, h - 1, WIDTH - 1, origin=(0.5, 0.5), step=(1.0, 1.0))))


@query("merge_tiles", f"""WITH {TILES} SELECT y, x, arg_min(value, priority) FILTER (WHERE value IS NOT NULL) AS b0, arg_min(priority + 1e0, priority) FILTER (WHERE value IS NOT NULL) AS b1,
arg_min(value <> 0, priority) FILTER (WHERE value IS NOT NULL) AS valid FROM t GROUP BY y, x HAVING count(value) > 0""")
def merge_tiles(spark, sf_dir):
    """The tiles of R as a scene of two bands on one grid: stack and validity."""
    t = tiles(spark, sf_dir).withColumn("tile", F.concat(F.lit("t"), F.col("priority")))
    pair = F.array(F.struct(F.lit("b0").alias("band"), F.col("value")), F.struct(F.lit("b1").alias("band"), F.when(F.col("value").isNotNull(), F.col("priority") + 1e0).alias("value")))
    long = t.select("tile", "y", "x", F.explode(pair).alias("b")).select("tile", "y", "x", "b.*")
    h = height(spark, sf_dir)
    meta = blocks.metadata(spark, h, WIDTH, step=(1.0, 1.0))
    names = F.array(*[F.struct(F.lit(f"t{i}").alias("tile"), F.lit(b).alias("band")) for i in range(3) for b in ("b0", "b1")])
    metas = meta.select(F.explode(names).alias("n"), "*").select("n.*", *meta.columns)
    stacked, valid, _ = scene.process(long, metas, meta, "simple")
    return stacked.join(valid, ["y", "x"]).select("y", "x", F.col("bands")[0].alias("b0"), F.col("bands")[1].alias("b1"), "valid")


# Fixed values of this fixture: class centroids over (customer / 1000, price / 100000).
CENTROIDS = [[0.1, 1.0], [0.9, 1.5], [0.5, 3.0], [0.2, 4.5]]


@query("predict_map", f"""WITH {R}, c AS (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))' for i, (a, b) in enumerate(CENTROIDS))}) t(cls, a, b)),
d AS (SELECT y, x, valid, c.cls, row_number() OVER (PARTITION BY y, x ORDER BY (cust / 1e3 - a) * (cust / 1e3 - a) + (price / 1e5 - b) * (price / 1e5 - b), c.cls) AS k FROM r, c)
SELECT y, x, CASE WHEN valid THEN (cls + 1) * 10 ELSE 255 END AS cls FROM d WHERE k = 1""")
def predict_map(spark, sf_dir):
    """R scored in overlapping patches, merged, mapped back to classes 10, 20, ..., nodata where invalid."""
    r = raster(spark, sf_dir)
    p = r.select("y", "x", F.array(F.col("cust") / 1e3, F.col("price").cast("double") / 1e5).alias("features"))
    back = literal(spark, [((k + 1) * 10, k) for k in range(len(CENTROIDS))], "orig int, idx int")
    return drivers.predict_map(p, scoring.NearestCentroid(CENTROIDS), height(spark, sf_dir), WIDTH, 32, 8, mapping=back, valid=r.select("y", "x", "valid"))


@query("rgb_jitter", f"""WITH v AS (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INT) AS pos, abs(CAST(unnest(embedding) AS DOUBLE)) + 5e-1 AS v, len(embedding) AS n FROM embeddings), d AS (SELECT *, {drawn('vec_id')} FROM v)
SELECT vec_id, pos, round(CASE WHEN pos < 3 AND n > 2 THEN greatest(0e0, pow(v, 8e-1 + 4e-1 * u1) * (9e-1 + 2e-1 * u2)) ELSE v END, 6) AS value FROM d""")
def rgb_jitter(spark, sf_dir):
    """Each vector as bands: the first three are jittered, the others stay."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double")) + 0.5).alias("v"))
    return e.select("vec_id", F.posexplode(normalize.rgb_jitter(F.col("v"), F.col("vec_id"))).alias("pos", "value")).withColumn("value", F.round("value", 6))
