"""Merging of overlapping patch predictions (y, x, cls, p, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted(probs: DataFrame) -> DataFrame:
    """(y, x, cls, p): sum(p * w) / sum(w) over the patches of a pixel; pixels without weight give 0."""
    return probs.groupBy("y", "x", "cls").agg(
        F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("w")), F.sum("w")), F.lit(0e0)).alias("p")
    )


def argmax(probs: DataFrame, by=("y", "x")) -> DataFrame:
    """(by..., cls, p): the class of the largest p, the smallest of ties (compared at 9 digits)."""
    m = F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("cls")).alias("c")))
    return probs.groupBy(*by).agg(m.alias("m")).select(*by, (-F.col("m.c")).cast("int").alias("cls"), F.col("m.p").alias("p"))


def naive(classes: DataFrame) -> DataFrame:
    """(y, x, cls): sum of the patches' class ids div their number."""
    return classes.groupBy("y", "x").agg(F.expr("cast(sum(cls) div count(*) as int)").alias("cls"))
