"""Raster algebra over pixel tables: validity, mosaics, resampling, sharpening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.expr import clip, cloud_bits


def validity(df: DataFrame, bands: Column, nodata: float = 0.0, cloud: Column | None = None) -> DataFrame:
    """Adds valid: no band is nodata (or null) and the cloud bits are clear."""
    bad = F.exists(bands, lambda b: b.isNull() | (b == nodata))
    if cloud is not None:
        bits = cloud_bits(cloud)
        bad = bad | bits["opaque"] | bits["cirrus"]
    return df.withColumn("valid", ~bad)


def cloud_share(df: DataFrame, col: str, by=()) -> DataFrame:
    """Percentage of pixels whose bit 3 is set."""
    return df.groupBy(*by).agg((F.avg(cloud_bits(F.col(col))["cloud8"].cast("int")) * 100).alias("cloud_pct"))


def merge_validity(tiles: DataFrame, rule: str = "first") -> DataFrame:
    """(y, x, valid) over overlapping tiles (y, x, priority, valid): first tile, all tiles or any tile."""
    v = F.col("valid")
    how = {"first": F.min_by(v, F.col("priority")), "all": F.bool_and(v), "any": F.bool_or(v)}[rule]
    return tiles.groupBy("y", "x").agg(how.alias("valid"))


def mosaic(tiles: DataFrame, value: str = "value") -> DataFrame:
    """(y, x, value): of the tiles of a pixel the first by priority that isn't null."""
    some = F.col(value).isNotNull()
    return tiles.groupBy("y", "x").agg(F.min_by(F.when(some, F.col(value)), F.when(some, F.col("priority"))).alias(value))


def crop(df: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Rows y0 <= y < y1, x0 <= x < x1, moved to start at 0; the bounds reach the scan as filters."""
    return df.filter((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def stack(long: DataFrame, bands: list[str], by=("y", "x")) -> DataFrame:
    """(by..., bands): an array by sorted band name; missing bands are null.  One aggregation, no join."""
    names = sorted(bands)
    p = long.groupBy(*by).pivot("band", names).agg(F.first("value"))
    return p.select(*by, F.array(*[F.col(f"`{n}`") for n in names]).alias("bands"))


def constant(spark: SparkSession, height: int, width: int, value: int = 0) -> DataFrame:
    """(y, x, cls) of one value."""
    ids = spark.range(height * width)
    return ids.select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), F.lit(value).alias("cls"))


def subsample(df: DataFrame, k: int) -> DataFrame:
    """Every k-th row and column."""
    return df.filter((F.col("y") % k == 0) & (F.col("x") % k == 0)).withColumns({"y": F.expr(f"y div {k}").cast("int"), "x": F.expr(f"x div {k}").cast("int")})


def nearest(df: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Resample by nearest pixel: target (y, x) reads floor((y + 0.5) * height / to_height), likewise x."""
    src = lambda v, n, m: F.floor((F.col(v) + 0.5) * F.lit(n) / F.lit(m)).cast("int")
    grid = constant(df.sparkSession, to_height, to_width).select("y", "x", src("y", height, to_height).alias("_y"), src("x", width, to_width).alias("_x"))
    s = df.withColumnsRenamed({"y": "_y", "x": "_x"})
    return grid.join(s, ["_y", "_x"]).drop("_y", "_x")


def bilinear(df: DataFrame, value: str, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """(y, x, value) on a target grid of the same extent, with half-pixel centres and clamped edges."""
    at = lambda v, n, m: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (F.col(v) + 0.5) * F.lit(n / m) - 0.5))
    grid = constant(df.sparkSession, to_height, to_width).select("y", "x", at("y", height, to_height).alias("fy"), at("x", width, to_width).alias("fx"))
    y0, x0 = F.floor("fy").cast("int"), F.floor("fx").cast("int")
    wy, wx = F.col("fy") - y0, F.col("fx") - x0
    corner = lambda dy, dx, w: F.struct(F.least(y0 + dy, F.lit(height - 1)).alias("_y"), F.least(x0 + dx, F.lit(width - 1)).alias("_x"), w.alias("_w"))
    taps = F.array(corner(0, 0, (1 - wy) * (1 - wx)), corner(0, 1, (1 - wy) * wx), corner(1, 0, wy * (1 - wx)), corner(1, 1, wy * wx))
    g = grid.select("y", "x", F.explode(taps).alias("t")).select("y", "x", "t.*").filter("_w > 0")
    s = df.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).cast("double").alias("_v"))
    return g.join(s, ["_y", "_x"]).groupBy("y", "x").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(value))


def keys_weight(d: Column, a: float = -0.5) -> Column:
    """Cubic convolution weight at distance d."""
    d = F.abs(d)
    near = (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(F.lit(0.0))


def cubic(df: DataFrame, value: str, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Separable cubic resize (16 taps), edges clamped."""
    at = lambda v, n, m: (F.col(v) + 0.5) * F.lit(n / m) - 0.5
    grid = constant(df.sparkSession, to_height, to_width).select("y", "x", at("y", height, to_height).alias("fy"), at("x", width, to_width).alias("fx"))
    k = F.sequence(F.lit(-1), F.lit(2))
    g = grid.select("*", F.explode(k).alias("dy")).select("*", F.explode(k).alias("dx"))
    ty, tx = F.floor("fy") + F.col("dy"), F.floor("fx") + F.col("dx")
    g = g.select("y", "x", clip(ty, 0, height - 1).cast("int").alias("_y"), clip(tx, 0, width - 1).cast("int").alias("_x"), (keys_weight(F.col("fy") - ty) * keys_weight(F.col("fx") - tx)).alias("_w"))
    s = df.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).cast("double").alias("_v"))
    return g.join(s, ["_y", "_x"]).groupBy("y", "x").agg(F.sum(F.col("_w") * F.col("_v")).alias(value))


def brovey(df: DataFrame, band: str, intensity: Column, eps: float = 1e-6) -> DataFrame:
    """Adds sharp: band * I / max(mean(I), eps), clipped to the band's own range."""
    d = df.withColumn("_i", intensity)
    stats = d.agg(F.avg("_i").alias("_m"), F.min(band).alias("_lo"), F.max(band).alias("_hi"))  # one row
    v = F.col(band) * F.col("_i") / F.greatest(F.col("_m"), F.lit(eps))
    return d.crossJoin(F.broadcast(stats)).withColumn("sharp", clip(v, F.col("_lo"), F.col("_hi"))).drop("_i", "_m", "_lo", "_hi")


def flip(df: DataFrame, height: int, width: int, how: str) -> DataFrame:
    """Coordinate permutations: ``h`` (mirror x), ``v`` (mirror y), ``r90`` (counter-clockwise), ``t`` (transpose)."""
    y, x = F.col("y"), F.col("x")
    to = {"h": (y, width - 1 - x), "v": (height - 1 - y, x), "r90": (width - 1 - x, y), "t": (x, y)}[how]
    return df.withColumns({"_y": to[0], "_x": to[1]}).drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})


def paste(base: DataFrame, objects: DataFrame, dy: int, dx: int, alpha: float = 1.0) -> DataFrame:
    """Paste object pixels (y, x, value, cls) moved by (dy, dx): value blended by alpha, class replaced."""
    o = objects.select((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("value").alias("_v"), F.col("cls").alias("_c"))
    j = base.join(o, ["y", "x"], "left")
    v = F.when(F.col("_v").isNull(), F.col("value")).otherwise(F.col("_v") * alpha + F.col("value") * (1 - alpha))
    return j.select("y", "x", v.alias("value"), F.coalesce("_c", "cls").alias("cls"))


def hpf(df: DataFrame, band: str, intensity: Column, eps: float = 1e-6, weight: float = 0.7) -> DataFrame:
    """Adds sharp: band + weight * (high - mean(high)), clipped to the band's own range.

    ``intensity`` holds the high-pass values of the fine band
    (``focal.high_pass``) at each pixel.
    """
    d = df.withColumn("_i", intensity)
    stats = d.agg(F.avg("_i").alias("_m"), F.min(band).alias("_lo"), F.max(band).alias("_hi"))  # one row
    v = F.col(band) + weight * (F.col("_i") - F.col("_m"))
    return d.crossJoin(F.broadcast(stats)).withColumn("sharp", clip(v, F.col("_lo"), F.col("_hi"))).drop("_i", "_m", "_lo", "_hi")


#: Resampling methods by name: (df, value, height, width, to_height, to_width) -> df.
RESAMPLE = {
    "nearest": lambda df, value, *shape: nearest(df, *shape),
    "bilinear": bilinear,
    "cubic": cubic,
}

#: Sharpening methods by name: (df, band, intensity) -> df with column sharp.
SHARPEN = {
    "simple": lambda df, band, intensity: df.withColumn("sharp", F.col(band)),
    "brovey": brovey,
    "hpf": hpf,
}
