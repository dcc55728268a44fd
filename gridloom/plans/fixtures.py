"""Domain objects made of the driver's tables, in Spark and as SQL.

raster R: ``orders`` laid out 100 pixels wide; patches E: ``embeddings`` as 8 x 8
patches; classes V: ``events`` binned by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 100


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.expr("cast(o_orderkey div 100 as int)").alias("y"),
        F.expr("cast(o_orderkey % 100 as int)").alias("x"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 10).alias("cls"),
        F.expr("cast(o_custkey % 6 as int)").alias("pred"),
        F.expr("cast(o_custkey % 6 as int) * 10").alias("pred10"),
        (F.col("o_orderstatus") != "P").alias("valid"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").cast("double").alias("cust"),
        F.col("o_custkey").cast("int").alias("bits"),
        F.col("o_orderkey").alias("pixel_id"),
    )


def height(spark, sf_dir: str) -> int:
    return (table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0) // WIDTH + 1


R = """r AS (SELECT CAST(o_orderkey // 100 AS INT) AS y, CAST(o_orderkey % 100 AS INT) AS x,
  CAST(substr(o_orderpriority, 1, 1) AS INT) * 10 AS cls, CAST(o_custkey % 6 AS INT) AS pred,
  CAST(o_custkey % 6 AS INT) * 10 AS pred10, o_orderstatus <> 'P' AS valid, o_totalprice AS price,
  CAST(o_custkey AS DOUBLE) AS cust, CAST(o_custkey AS INT) AS bits, o_orderkey AS pixel_id FROM orders),
h AS (SELECT max(y) + 1 AS h FROM r)"""


def tiles(spark, sf_dir: str) -> DataFrame:
    """Three overlapping row bands of R; status P is nodata (null) in the first alone."""
    r, h = raster(spark, sf_dir), height(spark, sf_dir)
    t = F.array(
        *[
            F.when((F.col("y") >= h * a) & (F.col("y") < h * b), F.lit(i))
            for i, (a, b) in enumerate([(0e0, 5e-1), (3e-1, 8e-1), (6e-1, 2e0)])
        ]
    )
    e = r.select("y", "x", "price", "valid", F.explode(F.filter(t, lambda v: v.isNotNull())).alias("priority"))
    value = F.when(~((F.col("priority") == 0) & ~F.col("valid")), F.col("price"))
    return e.select("y", "x", "priority", value.alias("value"), (F.col("valid") | (F.col("priority") != 0)).alias("valid"))


TILES = f"""{R}, t AS (SELECT r.y, r.x, p.priority, CASE WHEN NOT (p.priority = 0 AND NOT r.valid) THEN r.price END AS value,
  (r.valid OR p.priority <> 0) AS valid FROM r, h, (VALUES (0, 0e0, 5e-1), (1, 3e-1, 8e-1), (2, 6e-1, 2e0)) p(priority, a, b)
  WHERE r.y >= h.h * p.a AND r.y < h.h * p.b)"""


def patch_values(spark, sf_dir: str) -> DataFrame:
    """(image, band, pos, value): E with one band, positions 0..63."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("pos", "v"))
    return e.select("image", F.lit("b0").alias("band"), "pos", F.col("v").cast("double").alias("value"))


E = """e AS (SELECT vec_id AS image, 'b0' AS band, unnest(range(0, 64)) AS pos,
  CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings WHERE len(embedding) = 64)"""


def patch_labels(spark, sf_dir: str) -> DataFrame:
    """(patch_id, cls) of E, with rare classes 90 and 91."""
    e = table(spark, sf_dir, "embeddings")
    rare = F.when(F.col("vec_id") == 0, 91).when(F.col("vec_id").isin(1, 2), 90).otherwise(F.col("label"))
    return e.select(F.col("vec_id").alias("patch_id"), F.col("label").alias("cls"), rare.cast("int").alias("rare_cls"))


L = """l AS (SELECT vec_id AS patch_id, label AS cls, CAST(CASE WHEN vec_id = 0 THEN 91 WHEN vec_id IN (1, 2) THEN 90 ELSE label END AS INT) AS rare_cls FROM embeddings)"""


def event_classes(spark, sf_dir: str) -> DataFrame:
    """(patch_id, cls): user and value bin."""
    v = table(spark, sf_dir, "events").filter("value is not null")
    return v.select(F.col("user_id").alias("patch_id"), F.least(F.lit(9), F.floor(F.col("value") / 50)).cast("int").alias("cls"))


V = """v AS (SELECT user_id AS patch_id, CAST(least(9, floor(value / 50)) AS INT) AS cls FROM events WHERE value IS NOT NULL),
vc AS (SELECT cls, count(*) AS n FROM v GROUP BY cls)"""


def literal(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
