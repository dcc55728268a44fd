"""Scene inventories from path listings, and cloud percentages from metadata.

Listings are DataFrames with a ``path`` column, for instance of
``spark.read.format("binaryFile")`` without its content column; nothing lists
folders on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Band names by ground resolution in metres, and false-colour triples.
RESOLUTION = {
    10: ["B02", "B03", "B04", "B08"],
    20: ["B05", "B06", "B07", "B8A", "B11", "B12"],
    60: ["B01", "B09", "B10"],
}
COMPOSITES = {"natural": ["B04", "B03", "B02"], "vegetation": ["B08", "B04", "B03"], "urban": ["B12", "B11", "B04"], "geology": ["B12", "B08", "B02"]}
# File patterns of a band in order of priority ({} is the band).
PATTERNS = [r"_{}_[^/]*\.jp2$", r"_{}\.jp2$", r"_{}_[^/]*\.tif$", r"_{}\.tif$", r"{}[^/]*\.jp2$", r"{}[^/]*\.tif$"]
# Element names that hold a cloud percentage, in order.
CLOUD_TAGS = ["Cloud_Coverage_Assessment", "CLOUDY_PIXEL_PERCENTAGE", "CLOUD_COVERAGE_ASSESSMENT"]


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) below ``folder``; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def resolutions(spark: SparkSession) -> DataFrame:
    """(band, metres)."""
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(m).alias("metres")) for m, bs in RESOLUTION.items() for b in bs])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def composites(spark: SparkSession) -> DataFrame:
    """(name, channel, band) of the false-colour combinations."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("channel"), F.lit(b).alias("band")) for n, bs in COMPOSITES.items() for i, b in enumerate(bs)])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def scene_of(path: Column) -> Column:
    """The product folder or archive in a path; null if there is none."""
    s = F.regexp_extract(path, r"([^/]+?)\.(?:SAFE|zip)(?:/|$)", 1)
    return F.when(s != "", s)


def tile_of(scene: Column) -> Column:
    """The sixth part of the product name."""
    return F.get(F.split(scene, "_"), F.lit(5))


def band_of(path: Column) -> Column:
    """The last underscore part of the file name, before its first dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.split(F.element_at(F.split(name, "_"), -1), r"\.")[0]


def inventory(files: DataFrame) -> DataFrame:
    """(scene, tile, is_archive, n_files, needs_extract): archives whose folder isn't there need extraction."""
    f = files.withColumn("scene", scene_of(F.col("path"))).filter("scene is not null")
    zipped = F.col("path").endswith(".zip")
    return f.groupBy("scene").agg(F.bool_or(zipped).alias("is_archive"), F.count_if(~zipped).alias("n_files")).select(
        "scene", tile_of(F.col("scene")).alias("tile"), "is_archive", "n_files", (F.col("is_archive") & (F.col("n_files") == 0)).alias("needs_extract")
    )


def bands(files: DataFrame) -> DataFrame:
    """(scene, band, path, metres): image files in IMG_DATA, the true-colour preview left out."""
    f = files.filter(F.col("path").rlike(r"/IMG_DATA/(?:R\d+m/)?[^/]+\.jp2$") & ~F.col("path").contains("TCI"))
    b = f.select(scene_of(F.col("path")).alias("scene"), band_of(F.col("path")).alias("band"), "path")
    return b.join(F.broadcast(resolutions(files.sparkSession)), "band", "left").select("scene", "band", "path", "metres")


def find_bands(files: DataFrame) -> DataFrame:
    """(scene, band, path): for each known band the first file by pattern priority, then by path."""
    known = "|".join(b for bs in RESOLUTION.values() for b in bs)
    f = files.select(scene_of(F.col("path")).alias("scene"), "path")
    # the bands that a path names at all
    f = f.withColumn("band", F.explode(F.array_distinct(F.regexp_extract_all("path", F.lit(f"({known})"), F.lit(1)))))
    hits = F.array(*[F.regexp_like("path", F.concat(*_pieces(p))) for p in PATTERNS])
    c = f.withColumn("k", F.array_position(hits, True)).filter("k > 0")
    return c.withColumn("r", F.row_number().over(W.partitionBy("scene", "band").orderBy("k", "path"))).filter("r = 1").select("scene", "band", "path")


def _pieces(pattern: str) -> list[Column]:
    head, tail = pattern.split("{}")
    return [F.lit(head), F.col("band"), F.lit(tail)]


def missing_bands(found: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene, band): known bands that a scene lacks."""
    known = F.array(*[F.lit(b) for bs in RESOLUTION.values() for b in bs])
    every = scenes.select("scene").distinct().withColumn("band", F.explode(known))
    return every.join(found, ["scene", "band"], "left_anti")


def cloud_from_xml(xml: str) -> Column:
    """The first cloud percentage in the metadata text of column ``xml``, with or without a prefix.

    Patterns and not XPath: one malformed document must not fail the job.
    """
    found = "try_cast(nullif(regexp_extract({0}, '<(?:[A-Za-z0-9]+:)?{1}>([0-9]+[.]?[0-9]*)<', 1), '') as double)"
    return F.coalesce(*[F.expr(found.format(xml, t)) for t in CLOUD_TAGS])


def cloud_percentage(scenes: DataFrame, sidecar: DataFrame | None = None, default: float = 10.0) -> DataFrame:
    """(scene, cloud_pct, source) from columns product_xml, granule_xml and mask_pct, then a side-car (name, pct).

    Candidates in order: product metadata, granule metadata, the share of the
    classification mask, the side-car line that names the scene, the default.
    """
    g = scenes.withColumns({"c_product": cloud_from_xml("product_xml"), "c_granule": cloud_from_xml("granule_xml")})
    if sidecar is not None:
        # a line names a scene as one of its words; the first line of a scene counts
        words = F.array_distinct(F.regexp_extract_all("name", F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))
        side = sidecar.select(F.explode(words).alias("_scene"), F.col("pct").cast("double").alias("_pct"), F.col("line").alias("_line"))
        side = side.groupBy("_scene").agg(F.min_by("_pct", "_line").alias("c_side"))
        g = g.join(side, F.col("scene") == F.col("_scene"), "left").drop("_scene")
    else:
        g = g.withColumn("c_side", F.lit(None).cast("double"))
    order = [("product", "c_product"), ("granule", "c_granule"), ("mask", "mask_pct"), ("sidecar", "c_side")]
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in order], F.lit("default"))
    return g.select("scene", F.coalesce(*[F.col(c) for _, c in order], F.lit(default)).alias("cloud_pct"), source.alias("source"))


def usable(clouds: DataFrame, most: float = 10.0) -> DataFrame:
    """Adds valid: at most ``most`` percent clouds."""
    return clouds.withColumn("valid", F.col("cloud_pct") <= most)


def extract(spark: SparkSession, archives: str, present: DataFrame | None = None) -> DataFrame:
    """(archive, path, chunk, content) of every file in the zip archives below ``archives``.

    Archives of scenes in ``present`` (scene), which are there already, are left
    out; damaged archives give one row with a null path.  Members are read one by
    one, large ones in several chunks of 8 MB.
    """
    from gridloom.sources.zips import read_zip

    files = read_zip(spark, archives)
    if present is not None:
        files = files.withColumn("scene", scene_of(F.col("archive"))).join(present.select("scene").distinct(), "scene", "left_anti")
    return files.select("archive", F.col("member").alias("path"), "chunk", "content")


def product_folder(files: DataFrame) -> DataFrame:
    """(archive, folder, complete): the product folder nested in each archive of (archive, path); complete: it ends in .SAFE."""
    folder = F.regexp_extract("path", r"^(?:.*/)?([^/]+\.SAFE)/", 1)
    f = files.groupBy("archive").agg(F.min(F.when(folder != "", folder)).alias("folder"))
    return f.withColumn("complete", F.col("folder").isNotNull())


def cloud_masks(files: DataFrame) -> DataFrame:
    """(scene, path): each scene's cloud mask, the first path in QI_DATA that names clouds."""
    f = files.filter(F.col("path").rlike(r"/QI_DATA/[^/]*(?:CLD|MSK_CLASSI|MSK_CLOUDS)[^/]*\.(?:jp2|tif|gml)$"))
    return f.select(scene_of(F.col("path")).alias("scene"), "path").groupBy("scene").agg(F.min("path").alias("path"))


def mask_files(files: DataFrame, suffixes=("_mask.tif", ".tif", ".tiff")) -> DataFrame:
    """``files`` that end in the first of the ``suffixes`` that any file has."""
    rank = F.coalesce(*[F.when(F.col("path").endswith(s), F.lit(i)) for i, s in enumerate(suffixes)])
    f = files.withColumn("_rank", rank).filter("_rank is not null")
    best = f.agg(F.min("_rank").alias("_best"))
    return f.join(F.broadcast(best), F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def with_image(masks: DataFrame, images: DataFrame) -> DataFrame:
    """(path, image): masks whose image is there, the same path below ``images`` instead of ``masks``."""
    m = masks.select("path", F.regexp_replace("path", "/masks/", "/images/").alias("image"))
    return m.join(images.select(F.col("path").alias("image")), "image", "left_semi").select("path", "image")


def ordered_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(i, image, mask): files paired by their place in path order; surplus ones are left out."""
    at = lambda d, n: d.select(F.col("path").alias(n), (F.row_number().over(W.orderBy("path")) - 1).alias("i"))  # noqa: E731  a row a file
    return at(images, "image").join(at(masks, "mask"), "i").select("i", "image", "mask")
