"""Scene processing: bands of many tiles sharpened, aligned to a reference grid, merged and stacked.

Bands are one long table (tile, band, y, x, value), so all tiles go through the
same joins.  Resizing, alignment and box sums are separable: a table of taps
(target index, source index, weight) for each axis is joined first along y, then
along x, with partial sums before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import clip, fold_edge
from gridloom.operators import geometry
from gridloom.operators.raster import keys_weight, stack
from gridloom.sources import blocks, scenes

RGB, NEAR_INFRARED = ("B04", "B03", "B02"), "B08"
FINE = scenes.RESOLUTION[10]


def _targets(shapes: DataFrame, to: str) -> DataFrame:
    return shapes.filter(F.col(to) > 0).withColumn("t", F.explode(F.sequence(F.lit(0), (F.col(to) - 1).cast("int"))))


def cubic_taps(shapes: DataFrame, by: list[str], size: str, to: str) -> DataFrame:
    """(by..., t, s, w): cubic convolution from ``size`` to ``to`` pixels of the same extent, edges clamped."""
    n = F.col(size)
    at = (F.col("t") + 0.5) * n / F.col(to) - 0.5
    e = _targets(shapes, to).withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(2))))
    s = F.floor(at) + F.col("k")
    return e.select(*by, "t", clip(s, 0, n - 1).cast("int").alias("s"), keys_weight(at - s).alias("w")).filter("w <> 0")


def linear_taps(frames: DataFrame, by: list[str], axis: str) -> DataFrame:
    """(by..., t, s, w): two-point taps of a target grid in a source grid.

    ``frames`` has size, origin and step of both along the axis: n_y, o_y, d_y and
    to_n_y, to_o_y, to_d_y (or _x).  Targets whose centre lies outside the source
    have no taps; edges are clamped.
    """
    n, o, d, to_o, to_d = (F.col(f"{k}_{axis}") for k in ("n", "o", "d", "to_o", "to_d"))
    f = (to_o + (F.col("t") + 0.5) * to_d - o) / d
    e = _targets(frames, f"to_n_{axis}").filter((f >= 0) & (f < n)).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    at = f - 0.5
    frac = at - F.floor(at)
    w = F.when(F.col("k") == 1, frac).otherwise(1 - frac)
    return e.select(*by, "t", clip(F.floor(at) + F.col("k"), 0, n - 1).cast("int").alias("s"), w.alias("w")).filter("w > 0")


def box_taps(shapes: DataFrame, by: list[str], size: str, r: int = 1) -> DataFrame:
    """(by..., t, s, w): every pixel within r, edges reflected, weight 1."""
    e = _targets(shapes, size).withColumn("k", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    return e.select(*by, "t", fold_edge(F.col("t") + F.col("k"), F.col(size)).cast("int").alias("s"), F.lit(1.0).alias("w"))


def spread(long: DataFrame, by: list[str], on: list[str], along_y: DataFrame, along_x: DataFrame) -> DataFrame:
    """(by..., y, x, v, w): weighted sums of values that aren't null, and their weights; taps are keyed by ``on``."""

    def axis(df: DataFrame, taps: DataFrame, a: str, b: str) -> DataFrame:
        j = df.join(taps.withColumnsRenamed({"s": a, "w": "_w"}), [*on, a]).drop(a)
        g = j.groupBy(*by, "t", b).agg(F.sum(F.col("_w") * F.col("v")).alias("v"), F.sum(F.col("_w") * F.col("w")).alias("w"))
        return g.withColumnRenamed("t", a)

    v = long.filter("value is not null").select(*by, "y", "x", F.col("value").cast("double").alias("v"), F.lit(1.0).alias("w"))
    return axis(axis(v, along_y, "y", "x"), along_x, "x", "y").select(*by, "y", "x", "v", "w")


def fine_shapes(shapes: DataFrame) -> DataFrame:
    """(tile, to_height, to_width, fine, rgb, nir): each tile's largest grid, its number of 10 m bands, and whether it has RGB and B08."""
    band = lambda names: F.count_if(F.col("band").isin(*names))
    return shapes.groupBy("tile").agg(
        F.max("height").alias("to_height"), F.max("width").alias("to_width"),
        band(FINE).alias("fine"), (band(RGB) == 3).alias("rgb"), (band([NEAR_INFRARED]) > 0).alias("nir"),
    )


def sharpen(long: DataFrame, shapes: DataFrame, method: str = "brovey", eps: float = 1e-6, weight: float = 0.7) -> DataFrame:
    """(tile, band, y, x, value): every band of (tile, band, y, x, value) on its tile's finest grid.

    ``shapes``: (tile, band, height, width).  Coarser bands are resized by cubic
    convolution and sharpened: ``brovey`` where a tile has three 10 m bands or
    more, ``hpf`` where it has B08, else (and with ``simple``) resized alone.
    Results are clipped to the coarse band's range.  Null pixels, and pixels that
    need one, are left out.
    """
    if method not in ("simple", "brovey", "hpf"):
        raise ValueError(f"no sharpening method {method!r}")
    fine = fine_shapes(shapes)
    s = shapes.select("tile", "band", "height", "width").join(fine, "tile")
    coarse = s.filter((F.col("height") != F.col("to_height")) | (F.col("width") != F.col("to_width")))
    by = ["tile", "band"]
    kept = long.join(coarse.select(*by), by, "left_anti").filter("value is not null").select(*by, "y", "x", F.col("value").cast("double").alias("value"))
    low = long.join(coarse.select(*by), by, "left_semi")
    r = spread(low, by, by, cubic_taps(coarse, by, "height", "to_height"), cubic_taps(coarse, by, "width", "to_width"))
    r = r.filter(F.abs(F.col("w") - 1) < 1e-6).select(*by, "y", "x", F.col("v").alias("value"))
    if method != "simple":
        r = _sharpened(r, low, kept, s, fine, method, eps, weight)
    return kept.unionByName(r)


def _sharpened(r: DataFrame, low: DataFrame, kept: DataFrame, s: DataFrame, fine: DataFrame, method: str, eps: float, weight: float) -> DataFrame:
    """The resized bands ``r`` with the detail of the fine bands, where the tile has those that the method needs."""
    reach = low.groupBy("tile", "band").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    if method == "brovey":
        f = fine.filter("fine >= 3").select("tile", "rgb")
        of = lambda b: F.max(F.when(F.col("band") == b, F.col("value")))
        d = kept.join(f, "tile").filter(F.col("band").isin(*FINE)).groupBy("tile", "rgb", "y", "x").agg(*[of(b).alias(b) for b in FINE])
        d = d.select("tile", "y", "x", F.when(F.col("rgb"), sum(F.col(b) for b in RGB) / 3).otherwise(F.col(NEAR_INFRARED)).alias("_i"))
        value = F.col("value") * F.col("_i") / F.greatest(F.col("_m"), F.lit(eps))
    else:
        f = fine.filter("nir").select("tile")
        nir = kept.filter(F.col("band") == NEAR_INFRARED).select("tile", "y", "x", "value")
        grid = fine.filter("nir").select("tile", "to_height", "to_width")
        box = spread(nir, ["tile"], ["tile"], box_taps(grid, ["tile"], "to_height"), box_taps(grid, ["tile"], "to_width")).filter("w = 9")
        d = nir.join(box, ["tile", "y", "x"]).select("tile", "y", "x", ((10 * F.col("value") - F.col("v")) / 9).alias("_i"))
        value = F.col("value") + weight * (F.col("_i") - F.col("_m"))
    mean = d.groupBy("tile").agg(F.avg("_i").alias("_m"))
    j = r.join(d, ["tile", "y", "x"]).join(mean, "tile").join(reach, ["tile", "band"])
    sharp = j.select("tile", "band", "y", "x", clip(value, F.col("_lo"), F.col("_hi")).alias("value")).filter("value is not null")
    return sharp.unionByName(r.join(f.select("tile"), "tile", "left_anti"))


def align(long: DataFrame, metas: DataFrame, target: DataFrame) -> DataFrame:
    """(tile, band, y, x, value) on the grid of ``target`` (one metadata row), bilinear, same crs.

    ``metas``: (tile) and the metadata columns of the tile's grid.  Null pixels
    are left out of a mean; pixels without any neighbour have no row.
    """
    frame = lambda p, m: [F.col(f"{m}.{c}").alias(f"{p}{k}") for c, k in (("height", "n_y"), ("y0", "o_y"), ("dy", "d_y"), ("width", "n_x"), ("x0", "o_x"), ("dx", "d_x"))]
    f = metas.alias("a").crossJoin(F.broadcast(target.limit(1).alias("b"))).select("a.tile", *frame("", "a"), *frame("to_", "b"))  # one target row
    r = spread(long, ["tile", "band"], ["tile"], linear_taps(f, ["tile"], "y"), linear_taps(f, ["tile"], "x"))
    return r.filter("w > 0").select("tile", "band", "y", "x", (F.col("v") / F.col("w")).alias("value"))


def tile_validity(aligned: DataFrame, n_bands: DataFrame, nodata: float = 0.0, cloud: DataFrame | None = None) -> DataFrame:
    """(tile, y, x, valid): all of a tile's bands (``n_bands``: tile, n) hold data there, and no cloud (tile, y, x, cloudy) covers it.

    A pixel that a tile lacks altogether has no row, so a later tile answers for it.
    """
    g = aligned.groupBy("tile", "y", "x").agg(F.count_if(F.col("value") != nodata).alias("_n")).join(n_bands, "tile")
    v = g.select("tile", "y", "x", (F.col("_n") == F.col("n")).alias("valid"))
    if cloud is None:
        return v
    c = cloud.filter("cloudy").select("tile", "y", "x", F.lit(True).alias("_c")).distinct()
    return v.join(c, ["tile", "y", "x"], "left").select("tile", "y", "x", (F.col("valid") & F.col("_c").isNull()).alias("valid"))


def merge(aligned: DataFrame, validity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((band, y, x, value), (y, x, valid)): of overlapping tiles the first by name that has the pixel."""
    bands = aligned.filter("value is not null").groupBy("band", "y", "x").agg(F.min_by("value", "tile").alias("value"))
    return bands, validity.groupBy("y", "x").agg(F.min_by("valid", "tile").alias("valid"))


def process(
    long: DataFrame, metas: DataFrame, target: DataFrame, method: str = "brovey", *, nodata: float = 0.0, cloud: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(stack, validity, band order) of all tiles on the target grid.

    ``metas``: (tile, band) and the metadata columns.  stack: (y, x, bands), an
    array in the returned order (names sorted, of any tile); validity: (y, x, valid).
    """
    shapes = metas.select("tile", "band", "height", "width")
    area = F.col("height").cast("long") * F.col("width")
    kinds = ("height", "width", "x0", "y0", "dx", "dy")
    grid = metas.groupBy("tile").agg(F.max_by(F.struct(*kinds), F.struct(area, "band")).alias("g")).select("tile", "g.*")
    aligned = align(sharpen(long, shapes, method), grid, target)
    bands, valid = merge(aligned, tile_validity(aligned, shapes.groupBy("tile").agg(F.count_distinct("band").alias("n")), nodata, cloud))
    order = sorted(r["band"] for r in shapes.select("band").distinct().collect())  # names of bands, at most some dozens
    return stack(bands, order), valid, order


def check(files: DataFrame, metadata: DataFrame, metas: DataFrame, target: tuple[float, float, float, float], sidecar: DataFrame | None = None, most_cloud: float = 10.0) -> DataFrame:
    """One row a scene of a listing (path): tile, needs_extract, n_bands, missing, cloud_pct, source, valid, overlaps.

    ``metadata`` is what :func:`scenes.cloud_percentage` reads, ``metas`` (scene,
    band, metadata columns) gives the scenes' boxes, ``target`` is the reference
    box; overlaps is null where a scene has no box.
    """
    found = scenes.find_bands(files)
    inv = scenes.inventory(files).select("scene", "tile", "needs_extract")
    missing = scenes.missing_bands(found, inv).groupBy("scene").agg(F.sort_array(F.collect_list("band")).alias("missing"))  # 13 at most
    n = found.groupBy("scene").agg(F.count("*").alias("n_bands"))
    clouds = scenes.usable(scenes.cloud_percentage(metadata, sidecar), most_cloud)
    l, b, r, t = map(float, target)
    box = blocks.scene_bounds(metas, FINE)
    over = (F.col("left") < r) & (F.col("right") > l) & (F.col("bottom") < t) & (F.col("top") > b)
    j = inv.join(n, "scene", "left").join(missing, "scene", "left").join(clouds, "scene", "left").join(box.select("scene", over.alias("overlaps")), "scene", "left")
    none = F.array().cast("array<string>")
    return j.select("scene", "tile", "needs_extract", F.coalesce("n_bands", F.lit(0)).alias("n_bands"), F.coalesce("missing", none).alias("missing"), "cloud_pct", "source", "valid", "overlaps")


def ingest_plan(checked: DataFrame, metas: DataFrame, target: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(scenes to process, coverage): checked scenes that are clear and meet the target, and how much of it their boxes cover."""
    use = checked.filter("valid and overlaps")
    boxes = blocks.scene_bounds(metas, FINE).join(use.select("scene"), "scene", "left_semi").select("left", "bottom", "right", "top")
    return use.select("scene", "tile", "needs_extract"), geometry.coverage(boxes, target)


def band_vector(bands: Column, scale: float = 1e4) -> Column:
    """Features of a scorer: band values over ``scale``, nulls as 0."""
    return F.transform(bands, lambda v: F.coalesce(v.cast("double") / scale, F.lit(0.0)))
