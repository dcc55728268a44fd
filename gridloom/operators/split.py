"""Train, validation and test splits in a stable pseudo-random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.expr import stable_order


def _cut(n, share: float):
    """ceil(n * share), rounded to 9 digits first so that both engines agree."""
    return F.ceil(F.round(n * F.lit(share), 9)).cast("int")


def ranked(df: DataFrame, by: list[str], order: list[str], n: str = "_n", r: str = "_r", weight: str | None = None) -> DataFrame:
    """Adds the size n of each row's group and its rank r (from 1) in ``order``; with a weight, sums of weights.

    Groups are cut by range partitions of (by, order); ranks inside a partition
    are moved by a prefix sum over the partitions' totals, so no task holds a group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(parts, *by, *order).withColumn("_p", F.spark_partition_id())
    total = F.count("*") if weight is None else F.sum(weight)
    group = [F.col(c) for c in by] or [F.lit(0)]
    sums = d.groupBy("_p", *by).agg(total.alias("_t"))  # a row a partition and a group in it
    over = W.partitionBy(*group)
    before = F.sum("_t").over(over.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumns({"_before": F.coalesce(before, F.lit(0)), n: F.sum("_t").over(over)})
    sums = sums.select(F.col("_p").alias("_sp"), *[F.col(c).alias(f"_s_{c}") for c in by], "_before", n)
    inside = W.partitionBy("_p", *by).orderBy(*order)
    own = F.row_number().over(inside) if weight is None else F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    same = F.col("_p") == F.col("_sp")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    j = d.withColumn("_own", own).join(sums, same)
    return j.withColumn(r, F.col("_own") + F.col("_before")).drop("_p", "_sp", "_own", "_before", *[f"_s_{c}" for c in by])


def random_split(df: DataFrame, key: str, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Adds split: the first ceil(n * test) of the stable order are test, then val, then train."""
    j = ranked(df.withColumn("_h", stable_order(F.col(key))), [], ["_h", key])
    n_test = _cut(F.col("_n"), test)
    n_val = _cut(F.col("_n") - n_test, val / (1 - test))
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    return j.withColumn("split", split).drop("_h", "_n", "_r")


def stratified_split(df: DataFrame, key: str, cls: str = "cls", val: float = 0.15, test: float = 0.15, rare: bool = False) -> DataFrame:
    """Adds split by class: test = ceil(n * test), val = ceil(rest * val / (1 - test)), the rest train.

    With ``rare``, classes of one member go to train and of two to train and
    val; the others give test and val at least one each, rounded down.
    """
    d = ranked(df.withColumn("_h", stable_order(F.col(key))), [cls], ["_h", key]).drop("_h")
    if rare:
        part = lambda s: F.greatest(F.lit(1), F.floor(F.round(F.col("_n") * F.lit(s), 9))).cast("int")
        n_test, n_val = part(test), part(val)
        small = F.when(F.col("_n") == 1, F.lit("train")).when(F.col("_n") == 2, F.when(F.col("_r") == 1, "train").otherwise("val"))
        split = F.coalesce(small, F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train"))
    else:
        n_test = _cut(F.col("_n"), test)
        n_val = _cut(F.col("_n") - n_test, val / (1 - test))
        split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    return d.withColumn("split", split).drop("_r", "_n")


def report(df: DataFrame, cls: str = "cls") -> DataFrame:
    """(cls, train, val, test) counts."""
    p = df.groupBy(F.col(cls).alias("cls")).pivot("split", ["train", "val", "test"]).count()
    return p.select("cls", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("train", "val", "test")])


def recombine(parts: list[DataFrame]) -> DataFrame:
    """Splits put together again, without the split's name; columns are met by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("split")
