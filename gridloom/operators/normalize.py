"""Normalisation of band values and patch vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.expr import clip, finite_or

# Channel means and deviations of the pretrained RGB weights; other bands use 0.5.
RGB_MEAN, RGB_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def scale_reflectance(df: DataFrame, image: str, value: str = "value") -> DataFrame:
    """Divide by 10000 the images whose largest value exceeds 100."""
    big = df.groupBy(F.col(image).alias("_img")).agg((F.max(value) > 100).alias("_big"))
    return df.join(big, F.col(image) == F.col("_img")).withColumn(value, F.when(F.col("_big"), F.col(value) / 1e4).otherwise(F.col(value))).drop("_img", "_big")


def clean_values(df: DataFrame, value: str = "value", default: float = 0.0) -> DataFrame:
    return df.withColumn(value, finite_or(F.col(value), default))


def scale_and_clip(df: DataFrame, image: str, value: str = "value") -> DataFrame:
    """Images whose largest value exceeds 100 are divided by 10000; then all values are clipped to [0, 1]."""
    return scale_reflectance(df, image, value).withColumn(value, clip(F.col(value), 0.0, 1.0))


def fit_min_max(long: DataFrame) -> DataFrame:
    """(band, lo, hi): smallest and largest of the position-wise extremes over the images (image, band, pos, value)."""
    p = long.groupBy("band", "pos").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return p.groupBy("band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def fit_standard(long: DataFrame) -> DataFrame:
    """(band, mean, std): means over positions of the position-wise mean and population deviation."""
    p = long.groupBy("band", "pos").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return p.groupBy("band").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


def apply_min_max(long: DataFrame, fitted: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values to [low, high] by the fitted range; a band without range goes to ``low``."""
    unit = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0e0))
    return long.join(F.broadcast(fitted), "band").withColumn("value", unit * (high - low) + low).drop("lo", "hi")


def apply_standard(long: DataFrame, fitted: DataFrame, floor: float = 1e-6) -> DataFrame:
    z = (F.col("value") - F.col("mean")) / F.greatest(F.col("std"), F.lit(floor))
    return long.join(F.broadcast(fitted), "band").withColumn("value", z).drop("mean", "std")


def min_max_by_image(df: DataFrame, by, value: str = "value") -> DataFrame:
    """Per image and band: (v - min) / (max - min); constant ones stay as they are."""
    by = [by] if isinstance(by, str) else list(by)
    s = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = F.col(value)
    return df.join(s, by).withColumn(value, F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(v)).drop("_lo", "_hi")


def _by_position(k: Column, values, positions) -> Column:
    c = F.lit(0.5)
    for i, v in zip(positions, values):
        c = F.when(k == i, F.lit(v)).otherwise(c)
    return c


def pretrained(values: Column, rgb=(0, 1, 2)) -> Column:
    """An array of band values: RGB positions by the pretrained constants, others by (v - 0.5) / 0.5."""
    return F.transform(
        values, lambda v, k: (v.cast("double") - _by_position(k, RGB_MEAN, rgb)) / _by_position(k, RGB_STD, rgb)
    )


def fit_from_tags(tags: DataFrame, mode: str = "standard") -> DataFrame:
    """(raster_id, band, ...) from comma-joined tag strings band_names, STATISTICS_MEAN, STATISTICS_STDDEV.

    ``standard`` gives mean and std, ``min_max`` gives mean -+ 3 std.
    """
    part = lambda k: F.split(F.col("tags")[k], ",")
    z = F.arrays_zip(part("band_names").alias("band"), part("STATISTICS_MEAN").alias("mean"), part("STATISTICS_STDDEV").alias("std"))
    e = tags.select("raster_id", F.posexplode(z).alias("pos", "z")).select("raster_id", "pos", "z.band", F.col("z.mean").cast("double").alias("mean"), F.col("z.std").cast("double").alias("std"))
    if mode == "standard":
        return e
    return e.select("raster_id", "pos", "band", (F.col("mean") - 3 * F.col("std")).alias("lo"), (F.col("mean") + 3 * F.col("std")).alias("hi"))


def softmax(df: DataFrame, by, score: str = "score", to: str = "p") -> DataFrame:
    """Softmax of the rows of each key, with the largest score taken off first."""
    w = W.partitionBy(*([by] if isinstance(by, str) else by))
    e = F.exp(F.col(score) - F.max(score).over(w))
    d = df.withColumn("_e", e)
    return d.withColumn(to, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def even(seed: int, key: Column) -> Column:
    """A number of [0, 1) from a seed and a key, the same in any engine: 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32


def jitter(v: Column, key: Column, top: Column, seed: int = 0) -> Column:
    """Gamma (0.8 to 1.2) and brightness (0.9 to 1.1) jitter drawn for ``key``, clipped at 0; a null key gives null."""
    return F.greatest(F.lit(0.0), F.pow(v / top, 0.8 + 0.4 * even(seed + 1, key)) * top * (0.9 + 0.2 * even(seed + 2, key)))


def rgb_jitter(values: Column, key: Column, top: float = 1.0, rgb=(0, 1, 2), seed: int = 0) -> Column:
    """:func:`jitter` of the RGB places of a band array alone; arrays that lack one of them stay as they are."""
    moved = F.transform(values, lambda v, k: F.when(k.isin(*rgb), jitter(v.cast("double"), key, F.lit(top), seed)).otherwise(v.cast("double")))
    return F.when(F.size(values) > max(rgb), moved).otherwise(values.cast("array<double>"))
