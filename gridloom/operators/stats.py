"""Band statistics over long band tables (band, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import clip, stable_order
from gridloom.operators.split import ranked


def long_bands(df: DataFrame, bands: dict[str, str], keep=("y", "x")) -> DataFrame:
    """Wide band columns to (keep..., band, value); ``bands`` maps a name to its column."""
    s = F.array(*[F.struct(F.lit(n).alias("band"), F.col(c).cast("double").alias("value")) for n, c in bands.items()])
    return df.select(*keep, F.explode(s).alias("e")).select(*keep, "e.band", "e.value")


def sample_positions(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by a stable pseudo-random order of ``key``, without replacement."""
    return df.orderBy(stable_order(F.col(key)), key).limit(n)


def positive_stats(long: DataFrame) -> DataFrame:
    """(band, lo, hi, mean, std) over values > 0; over all values where a band has none."""
    v = F.col("value")
    some = F.count_if(v > 0) > 0

    def pick(f):
        return F.when(some, f(F.when(v > 0, v))).otherwise(f(v))

    return long.groupBy("band").agg(
        pick(F.min).alias("lo"), pick(F.max).alias("hi"), pick(F.avg).alias("mean"), pick(F.stddev_pop).alias("std")
    )


def nan_free_stats(long: DataFrame) -> DataFrame:
    """(band, lo, hi, mean, std) without NaN and null; bands without values get 0, 1, 0, 1."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy("band").agg(
        F.coalesce(F.min(v), F.lit(0e0)).alias("lo"),
        F.coalesce(F.max(v), F.lit(1e0)).alias("hi"),
        F.coalesce(F.avg(v), F.lit(0e0)).alias("mean"),
        F.coalesce(F.stddev_pop(v), F.lit(1e0)).alias("std"),
    )


def percentiles(long: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(band, p_low, p_high), linearly interpolated and exact; nulls don't count.

    Values are counted first; ranks come from range partitions of (band, value)
    and prefix sums, so no task holds a band.
    """
    counts = long.filter(F.col("value").isNotNull()).groupBy("band", "value").agg(F.count("*").alias("_c"))
    r = ranked(counts, ["band"], ["value"], weight="_c")

    def at(k):
        """The value of rank k (from 0)."""
        return F.max(F.when((F.col("_r") > k) & (F.col("_r") - F.col("_c") <= k), F.col("value").cast("double")))

    place = {n: F.lit(q) * (F.col("_n") - 1) for n, q in (("low", low), ("high", high))}
    picked = r.groupBy("band").agg(
        *[f(p).alias(f"{n}_{k}") for n, p in place.items() for k, f in (("a", lambda p: at(F.floor(p))), ("b", lambda p: at(F.ceil(p))))],
        *[F.max(p - F.floor(p)).alias(f"{n}_f") for n, p in place.items()],
    )
    mixed = lambda n: F.col(f"{n}_a") * (1 - F.col(f"{n}_f")) + F.col(f"{n}_b") * F.col(f"{n}_f")
    return picked.select("band", mixed("low").alias("p_low"), mixed("high").alias("p_high"))


def stretch(long: DataFrame, bounds: DataFrame) -> DataFrame:
    """value -> clip((value - p_low) / (p_high - p_low), 0, 1); flat bands give 0."""
    span = F.col("p_high") - F.col("p_low")
    s = F.coalesce(F.try_divide(F.col("value") - F.col("p_low"), span), F.lit(0e0))
    return long.join(F.broadcast(bounds), "band").withColumn("value", clip(s, 0.0, 1.0)).drop("p_low", "p_high")


def epoch_means(log: DataFrame, value: str = "loss", by=("epoch",)) -> DataFrame:
    return log.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"))
