"""Losses and Dice over scored samples (sample, cls, score, y_true)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_softmax(df: DataFrame, by: str = "sample") -> DataFrame:
    """Adds lp, the log-softmax over the sample's classes."""
    w = W.partitionBy(by)
    d = df.withColumn("_z", F.col("score") - F.max("score").over(w))
    return d.withColumn("lp", F.col("_z") - F.log(F.sum(F.exp("_z")).over(w))).drop("_z")


def focal(df: DataFrame, alpha: DataFrame, gamma: float = 2.0, most: float = 10.0) -> DataFrame:
    """One row: mean of alpha * (1 - p)^gamma * -log p at the true class.

    alpha is held at ``most`` times its smallest and then made to sum to 1.
    """
    every = W.partitionBy(F.lit(0))  # a row a class
    a = alpha.select(F.col("cls").alias("_c"), F.least(F.col("alpha"), F.min("alpha").over(every) * most).alias("_a"))
    a = a.withColumn("_a", F.col("_a") / F.sum("_a").over(every))
    t = log_softmax(df).filter(F.col("cls") == F.col("y_true")).join(F.broadcast(a), F.col("cls") == F.col("_c"))
    nll = -F.col("lp")
    return t.agg(F.avg(F.col("_a") * F.pow(1 - F.exp(-nll), F.lit(gamma)) * nll).alias("focal_loss"))


def ce_dice(df: DataFrame, weights: DataFrame, group: str, ce_weight: float = 0.7, dice_weight: float = 0.3, ignore: int = -100) -> DataFrame:
    """One row: ce, dice_loss and their weighted sum.

    Dice per (group, class) over the classes that ``df`` scores; a class without
    any mass, true or predicted, scores 1.
    """
    d = log_softmax(df.filter(F.col("y_true") != ignore)).join(F.broadcast(weights.select(F.col("cls").alias("_c"), "weight")), F.col("cls") == F.col("_c"))
    hit = F.col("cls") == F.col("y_true")
    ce = d.filter(hit).agg((F.sum(-F.col("lp") * F.col("weight")) / F.sum("weight")).alias("ce"))
    p = F.exp("lp")
    g = d.groupBy(group, "cls").agg(
        F.sum(F.when(hit, p).otherwise(0e0)).alias("i"), F.sum(p).alias("p"), F.sum(hit.cast("double")).alias("t")
    )
    mass = F.col("p") + F.col("t")
    s = F.when(mass > 0, 2 * F.col("i") / (mass + F.lit(1e-5))).otherwise(F.lit(1e0))
    dl = g.agg((1 - F.avg(s)).alias("dice_loss"))
    return ce.crossJoin(dl).withColumn("loss", F.col("ce") * ce_weight + F.col("dice_loss") * dice_weight)
