"""Rasters as block tables: a folder with ``pixels`` and ``meta``, both Parquet.

``pixels`` holds (y, x, value) by band and block row, so that a read of a few
bands or of a window opens only their files.  ``meta`` is one row: size, block,
nodata, crs, the affine origin and step, and free tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

META = "height int, width int, block int, nodata double, crs string, x0 double, y0 double, dx double, dy double, tags map<string,string>"


def metadata(spark: SparkSession, height: int, width: int, *, block: int = 256, nodata: float | None = None, crs: str = "EPSG:32634",
             origin=(0.0, 0.0), step=(10.0, -10.0), tags: dict[str, str] | None = None) -> DataFrame:
    """The one-row description of a raster."""
    kinds = dict(f.split(" ") for f in META.split(", "))
    values = dict(zip(kinds, (height, width, block, nodata, crs, *origin, *step)))
    columns = [F.lit(v).cast(kinds[k]).alias(k) for k, v in values.items()]
    pairs = [F.lit(x) for kv in (tags or {}).items() for x in kv]
    return spark.range(1).select(*columns, F.create_map(*pairs).cast("map<string,string>").alias("tags"))


def write_raster(pixels: DataFrame, meta: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (band, y, x, value) with its metadata; blocks of a band are sorted together."""
    block = meta.select(F.col("block").alias("_block"))
    by = F.floor(F.col("y") / F.col("_block")).cast("int")
    p = pixels.select("band", "y", "x", F.col("value").cast("double").alias("value")).crossJoin(F.broadcast(block)).withColumn("by", by).drop("_block")
    p.repartition("band", "by").sortWithinPartitions("band", "by", "y", "x").write.mode(mode).partitionBy("band", "by").parquet(f"{path}/pixels")
    meta.write.mode(mode).parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).parquet(f"{path}/meta")


def read_raster(spark: SparkSession, path: str, bands: list[str] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(band, y, x, value), nodata as null; of ``bands`` and of the ``window`` (y0, y1, x0, x1; ends exclusive) alone."""
    m = read_meta(spark, path).select("block", "nodata").first()
    p = spark.read.schema("y int, x int, value double, band string, by int").parquet(f"{path}/pixels")
    if bands is not None:
        p = p.filter(F.col("band").isin(bands))
    if window is not None:
        y0, y1, x0, x1 = window
        inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
        p = p.filter((F.col("by") >= y0 // m["block"]) & (F.col("by") <= (y1 - 1) // m["block"]) & inside)
    value = F.col("value") if m["nodata"] is None else F.when(F.col("value") != m["nodata"], F.col("value"))
    return p.select("band", "y", "x", value.alias("value"))


def describe(spark: SparkSession, path: str, band: str) -> DataFrame:
    """One row: size, crs, nodata, tags and the distinct values of a class band, sorted."""
    values = read_raster(spark, path, [band]).filter("value is not null").select(F.col("value").cast("int").alias("v")).distinct()
    return read_meta(spark, path).select("height", "width", "crs", "nodata", "tags").crossJoin(F.broadcast(values.agg(F.sort_array(F.collect_list("v")).alias("values"))))


def bounds(meta: DataFrame) -> DataFrame:
    """left, bottom, right, top and crs of each metadata row; other columns stay."""
    x1, y1 = F.col("x0") + F.col("width") * F.col("dx"), F.col("y0") + F.col("height") * F.col("dy")
    return meta.withColumns({"left": F.least("x0", x1), "bottom": F.least("y0", y1), "right": F.greatest("x0", x1), "top": F.greatest("y0", y1)})


def scene_bounds(metas: DataFrame, preferred: list[str]) -> DataFrame:
    """(scene, band, left, bottom, right, top, crs) by the first of the ``preferred`` bands that a scene has, else its first band by name.

    ``metas`` has a scene and a band beside the metadata columns.
    """
    order = F.array_position(F.array(*[F.lit(b) for b in preferred]), F.col("band"))
    rank = F.row_number().over(W.partitionBy("scene").orderBy((order == 0), order, "band"))
    first = metas.withColumn("_r", rank).filter("_r = 1")
    return bounds(first).select("scene", "band", "left", "bottom", "right", "top", "crs")


def write_class_map(classes: DataFrame, like: DataFrame, path: str, *, nodata: int = 0, mode: str = "errorifexists") -> None:
    """A class map (y, x, cls) with the metadata of ``like``; missing classes are written as ``nodata`` (0 or 255)."""
    p = classes.select(F.lit("cls").alias("band"), "y", "x", F.coalesce("cls", F.lit(nodata)).alias("value"))
    write_raster(p, like.withColumn("nodata", F.lit(float(nodata))), path, mode)


def assembled(spark: SparkSession, path: str, make) -> DataFrame:
    """The raster at ``path``; where there is none, ``make()`` gives (pixels, meta), which is written first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        pixels, meta = make()
        write_raster(pixels, meta, path)
    return read_raster(spark, path)


def prediction_info(metrics: DataFrame, meta: DataFrame, model: str) -> DataFrame:
    """One row, json: the model, the map's size and crs, and the metrics' one row."""
    one = metrics.select(F.struct(*metrics.columns).alias("metrics"))
    j = meta.select("height", "width", "crs").crossJoin(F.broadcast(one))
    return j.select(F.to_json(F.struct(F.lit(model).alias("model"), "height", "width", "crs", "metrics")).alias("json"))


def pixel_bounds(left: Column, top: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """(y, x) of a map position."""
    return F.floor((top - y0) / dy).cast("int"), F.floor((left - x0) / dx).cast("int")
