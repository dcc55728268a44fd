"""Class weights and rare-class over-sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _all():
    """One window over a class table (a row a class)."""
    return W.partitionBy(F.lit(0))


def fill_classes(counts: DataFrame) -> DataFrame:
    """(cls, n) with every class from 0 to the largest; missing ones count 0."""
    top = counts.agg(F.max("cls").alias("top"))
    ids = top.select(F.explode(F.sequence(F.lit(0), "top")).alias("cls"))
    return ids.join(counts, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sqrt_inverse(counts: DataFrame, most: float = 10.0) -> DataFrame:
    """(cls, weight): sqrt(total / (classes * max(n, 1))), at most ``most`` times the smallest, summing to the number of classes."""
    c = fill_classes(counts)
    k = F.count("*").over(_all())
    raw = F.sqrt(F.sum("n").over(_all()) / (k * F.greatest("n", F.lit(1))))
    a = c.withColumn("k", k).withColumn("w", raw)
    b = a.withColumn("w", F.least("w", F.min("w").over(_all()) * F.lit(most)))
    return b.select("cls", (F.col("w") * F.col("k") / F.sum("w").over(_all())).alias("weight"))


def balanced_alpha(counts: DataFrame, top: float = 0.3) -> DataFrame:
    """(cls, alpha): 1 / sqrt(n), to sum 1, at most ``top``, to sum 1 again."""
    a = counts.withColumn("a", 1 / F.sqrt(F.greatest("n", F.lit(1))))
    b = a.withColumn("a", F.least(F.col("a") / F.sum("a").over(_all()), F.lit(top)))
    return b.select("cls", (F.col("a") / F.sum("a").over(_all())).alias("alpha"))


def sampling_factors(counts: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """(cls, n, factor): ceil(1 + (high - low) * rarity), rarity = -log10 share scaled to [0, 1] over the classes."""
    r = -F.log10(F.col("n") / F.sum("n").over(_all()))
    a = counts.filter("n > 0").withColumn("r", r)
    span = F.max("r").over(_all()) - F.min("r").over(_all())
    unit = F.coalesce(F.try_divide(F.col("r") - F.min("r").over(_all()), span), F.lit(0e0))
    return a.select("cls", "n", F.ceil(F.lit(1e0) + F.lit(high - low) * F.round(unit, 9)).cast("int").alias("factor"))


def oversample(members: DataFrame, factors: DataFrame, key: str = "patch_id") -> DataFrame:
    """The members once each, and factor - 1 further copies for each (member, cls) of a rare class: (key, copies)."""
    extra = members.select(key, "cls").distinct().join(F.broadcast(factors), "cls").filter("factor > 1")
    copies = extra.select(key, F.explode(F.sequence(F.lit(1), F.col("factor") - 1)).alias("_c")).select(key)
    return members.select(key).distinct().unionAll(copies).groupBy(key).agg(F.count("*").alias("copies"))
