"""Patch grids, patch membership and patch filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.expr import clip, overlap_of, patch_name, stable_order
from gridloom.operators.split import ranked


def _grid(spark: SparkSession, ys: tuple, xs: tuple) -> DataFrame:
    """(y0, x0) of two axes, each (number, stride, last start or None): rows of a range, so Spark deals them out and knows how many there are."""
    at = lambda k, axis: (k * axis[1] if axis[2] is None else F.least(k * axis[1], F.lit(axis[2]))).cast("int")
    across = max(xs[0], 1)
    g = spark.range(ys[0] * xs[0])
    return g.select(at(F.floor(F.col("id") / across), ys).alias("y0"), at(F.col("id") % across, xs).alias("x0"))


def grid_floor(spark: SparkSession, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """(y0, x0): full patches alone; what a last stride doesn't fill stays uncovered."""
    s = size - overlap
    n = lambda a: max((a - size) // s + 1, 0)
    return _grid(spark, (n(height), s, None), (n(width), s, None))


def grid_clamp(spark: SparkSession, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """(y0, x0): as many strides as cover everything, the last moved back inside."""
    s = size - overlap
    n = lambda a: max(-(-(a - size) // s), 0) + 1
    return _grid(spark, (n(height), s, max(height - size, 0)), (n(width), s, max(width - size, 0))).distinct()


def _padded(n: int, size: int, overlap: int) -> int:
    """Number of padded windows along an axis of n pixels."""
    return max(-(-(n - 2 * overlap) // (size - 2 * overlap)), 1)


def grid_padded(spark: SparkSession, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """(y0, x0) of a reflect-padded image: stride size - 2 * overlap, as many as cover the inner part."""
    s = size - 2 * overlap
    return _grid(spark, (_padded(height, size, overlap), s, None), (_padded(width, size, overlap), s, None))


def in_padded(pixels: DataFrame, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """Each pixel once for every place that it or its mirror image takes in a window of :func:`grid_padded`: adds y0, x0, dy, dx.

    A pixel shows at its own place and behind both edges (one bounce, the edge
    repeated); windows follow from a place by arithmetic, so nothing is joined.
    """
    s = size - 2 * overlap

    def places(v: Column, n: int) -> Column:
        def windows(p: Column) -> Column:
            lo = F.greatest(F.lit(0), F.ceil((p + overlap - size + 1) / s)).cast("int")
            hi = F.least(F.lit(_padded(n, size, overlap) - 1), F.floor((p + overlap) / s)).cast("int")
            ks = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
            return F.transform(ks, lambda k: F.struct((k * s).alias("at"), (p + overlap - k * s).alias("d")))

        return F.concat(*[windows(p) for p in (v, -v - 1, 2 * n - 1 - v)])

    e = pixels.select("*", F.explode(places(F.col("y"), height)).alias("_py")).select("*", F.explode(places(F.col("x"), width)).alias("_px"))
    at = {"y0": F.col("_py.at"), "x0": F.col("_px.at"), "dy": F.col("_py.d"), "dx": F.col("_px.d")}
    return e.withColumns(at).drop("_py", "_px")


def chunk_grid(spark: SparkSession, height: int, width: int, chunk: int, halo: int) -> DataFrame:
    """Chunks with the rows they read (y0, y1, x0, x1) and the inner part they own (vy0, ...); together the inner parts tile the image."""
    g = _grid(spark, (-(-height // chunk), chunk, None), (-(-width // chunk), chunk, None)).withColumnsRenamed({"y0": "vy0", "x0": "vx0"})
    vy1, vx1 = F.least(F.col("vy0") + chunk, F.lit(height)), F.least(F.col("vx0") + chunk, F.lit(width))
    return g.select(
        F.greatest(F.col("vy0") - halo, F.lit(0)).alias("y0"),
        F.least(vy1 + halo, F.lit(height)).alias("y1"),
        F.greatest(F.col("vx0") - halo, F.lit(0)).alias("x0"),
        F.least(vx1 + halo, F.lit(width)).alias("x1"),
        "vy0",
        vy1.alias("vy1"),
        "vx0",
        vx1.alias("vx1"),
    )


def in_chunks(pixels: DataFrame, chunks: DataFrame, chunk: int, halo: int) -> DataFrame:
    """Each pixel once for every chunk of :func:`chunk_grid` that reads it: adds the chunk's columns and own, whether the chunk owns it.

    The chunks that may read a pixel follow by arithmetic and meet the grid by
    their corner, so neither side is spread out over the cells of a chunk.
    """
    at = lambda v: F.explode(F.sequence(F.floor((F.col(v) - halo) / chunk).cast("int"), F.floor((F.col(v) + halo) / chunk).cast("int")))
    e = pixels.select("*", at("y").alias("_ky")).select("*", at("x").alias("_kx"))
    e = e.withColumns({"vy0": F.col("_ky") * chunk, "vx0": F.col("_kx") * chunk}).drop("_ky", "_kx").join(chunks, ["vy0", "vx0"])
    own = (F.col("y") >= F.col("vy0")) & (F.col("y") < F.col("vy1")) & (F.col("x") >= F.col("vx0")) & (F.col("x") < F.col("vx1"))
    return e.withColumn("own", own)


def cover(pixels: DataFrame, height: int, width: int, size: int, overlap: int, clamp: bool = True) -> DataFrame:
    """Each pixel once for every patch that holds it: adds y0, x0, dy, dx.

    Patch starts follow from the pixel's position by arithmetic, so this is an
    explode without a range join.  ``clamp`` is :func:`grid_clamp`, otherwise
    :func:`grid_floor`.
    """
    s = size - overlap

    def starts(v: Column, n: int) -> Column:
        if not clamp:
            last = (n - size) // s
            if last < 0:
                return F.array().cast("array<int>")
            ks = F.sequence(F.greatest(F.lit(0), F.ceil((v - size + 1) / s)).cast("int"), F.floor(v / s).cast("int"))
            ks = F.when(F.ceil((v - size + 1) / s) <= F.floor(v / s), ks).otherwise(F.array().cast("array<int>"))
            return F.transform(F.filter(ks, lambda k: k <= last), lambda k: k * s)
        last, most = -(-max(n - size, 0) // s), max(n - size, 0)
        lo = F.greatest(F.lit(0), F.ceil((v - size + 1) / s)).cast("int")
        hi = F.least(F.lit(last), F.floor(v / s).cast("int"))
        regular = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        own = F.transform(regular, lambda k: F.least(k * s, F.lit(most)))
        # the moved-back last patch starts earlier than its stride says
        return F.array_distinct(F.when(v >= most, F.array_union(own, F.array(F.lit(most)))).otherwise(own))

    e = pixels.select("*", F.explode(starts(F.col("y"), height)).alias("y0")).select("*", F.explode(starts(F.col("x"), width)).alias("x0"))
    return e.withColumns({"dy": F.col("y") - F.col("y0"), "dx": F.col("x") - F.col("x0")})


def majority(df: DataFrame, by, col: str = "cls") -> DataFrame:
    """(by..., major, n_major): the most frequent class, the smallest of ties."""
    by = [by] if isinstance(by, str) else list(by)
    c = df.groupBy(*by, F.col(col).alias("_c")).agg(F.count("*").alias("_n"))
    m = c.groupBy(*by).agg(F.max(F.struct("_n", (-F.col("_c")).alias("_c"))).alias("m"))
    return m.select(*by, (-F.col("m._c")).cast("int").alias("major"), F.col("m._n").alias("n_major"))


def valid_fraction(df: DataFrame, by, valid: str = "valid") -> DataFrame:
    """(by..., fraction) of valid pixels."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.avg(F.col(valid).cast("int")).alias("fraction"))


def keep_valid(fractions: DataFrame, least: float = 0.7) -> DataFrame:
    return fractions.filter(F.col("fraction") >= least)


def rare_patches(df: DataFrame, rare: list[int], by, col: str = "cls") -> DataFrame:
    """(by..., classes): patches with any rare class, and which."""
    by = [by] if isinstance(by, str) else list(by)
    return df.filter(F.col(col).isin(rare)).groupBy(*by).agg(F.sort_array(F.collect_set(col)).alias("classes"))


def rare_windows(pixels: DataFrame, rare: list[int], height: int, width: int, size: int, per_class: int = 30, key: str = "pixel_id") -> DataFrame:
    """(y0, x0): distinct windows centred on up to ``per_class`` pixels of each rare class, moved inside.

    The pixels are the first in a stable pseudo-random order; each class keeps
    its own smallest in a bounded aggregate, not in a window over all pixels.
    """
    from pyspark.sql import Window as W

    p = pixels.filter(F.col("cls").isin(rare)).withColumn("_h", stable_order(F.col(key)))
    # first thin each (class, salt), then the class: no task sees a whole class
    salted = W.partitionBy("cls", F.pmod(F.xxhash64(key), F.lit(64))).orderBy("_h", key)
    p = p.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= per_class)
    p = p.withColumn("_r", F.row_number().over(W.partitionBy("cls").orderBy("_h", key))).filter(F.col("_r") <= per_class)
    at = lambda v, n: clip(F.col(v) - size // 2, 0, n - size).cast("int")
    return p.select(at("y", height).alias("y0"), at("x", width).alias("x0")).distinct()


def add_patches(grid: DataFrame, extra: DataFrame) -> DataFrame:
    """The grid and those extra windows it doesn't hold."""
    return grid.unionByName(extra.join(grid, ["y0", "x0"], "left_anti"))


def named(patches: DataFrame) -> DataFrame:
    """patch_id in order of place, ranked by range partitions, and its file name."""
    p = ranked(patches, [], ["y0", "x0"], "_n", "patch_id").drop("_n")
    return p.withColumn("patch_id", (F.col("patch_id") - 1).cast("int")).withColumn("name", patch_name(F.col("patch_id")))


def centred_window(pixels: DataFrame, centres: DataFrame, size: int, value: str) -> DataFrame:
    """(cy, cx, dy, dx, value): the size x size window whose pixel size // 2 is the centre; 0 outside the raster."""
    half = size // 2
    side = F.sequence(F.lit(0), F.lit(size - 1))
    w = centres.select(F.col("y").alias("cy"), F.col("x").alias("cx"), F.explode(side).alias("dy")).select("cy", "cx", "dy", F.explode(side).alias("dx"))
    p = pixels.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).alias("_v"))
    on = (F.col("_y") == F.col("cy") + F.col("dy") - half) & (F.col("_x") == F.col("cx") + F.col("dx") - half)
    return w.join(p, on, "left").select("cy", "cx", "dy", "dx", F.coalesce("_v", F.lit(0)).alias(value))


def overlap(spark: SparkSession, rows: list[tuple[int, int]]) -> DataFrame:
    """(rf, size, overlap) for receptive fields and patch sizes."""
    return spark.createDataFrame(rows, "rf int, size int").withColumn("overlap", overlap_of(F.col("rf"), F.col("size")))
