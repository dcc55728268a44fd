"""Confusion matrices and the metrics that follow from them.

Everything after :func:`confusion` works on at most (number of classes)^2 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scored_pixels(df: DataFrame, rule: str = "positive_truth", truth: str = "cls", pred: str = "pred") -> DataFrame:
    """Pixels that count: ``positive_truth`` (truth > 0), ``known`` (pred not 255, truth not 0) or ``byte`` (0 <= truth < 255)."""
    t, p = F.col(truth), F.col(pred)
    return df.filter({"positive_truth": t > 0, "known": (p != 255) & (t != 0), "byte": (t >= 0) & (t < 255)}[rule])


def confusion(df: DataFrame, truth: str = "cls", pred: str = "pred", labels: DataFrame | None = None) -> DataFrame:
    """(y_true, y_pred, n) for all pairs of ``labels`` (cls); default: all classes of both sides."""
    counts = df.groupBy(F.col(truth).cast("int").alias("y_true"), F.col(pred).cast("int").alias("y_pred")).agg(F.count("*").alias("n"))
    if labels is None:
        labels = counts.select(F.explode(F.array("y_true", "y_pred")).alias("cls")).distinct()
    a, b = labels.select(F.col("cls").alias("y_true")), labels.select(F.col("cls").alias("y_pred"))
    grid = a.crossJoin(F.broadcast(b))  # labels x labels, bounded by the class domain
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def normalized(cm: DataFrame) -> DataFrame:
    """Row shares: ``share`` (0 for empty rows), ``share_null`` (null there) and ``share_eps`` (n / (row + 1e-8))."""
    row = F.sum("n").over(W.partitionBy("y_true"))
    share = F.try_divide(F.col("n").cast("double"), row)
    return cm.select("y_true", "y_pred", "n", F.coalesce(share, F.lit(0e0)).alias("share"), share.alias("share_null"), (F.col("n") / (row + F.lit(1e-8))).alias("share_eps"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0e0))


def counts(cm: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn, support) from a confusion matrix."""
    both = cm.select(
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("cls"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fn")),
                F.struct(F.col("y_pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
            )
        ).alias("e")
    ).select("e.*")
    return both.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum(F.col("tp") + F.col("fn")).alias("support"))


def per_class(cm: DataFrame) -> DataFrame:
    """(cls, precision, recall, f1, iou, support); empty denominators give 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts(cm).select(
        "cls",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fp + fn).alias("iou"),
        "support",
    )


def summary(cm: DataFrame) -> DataFrame:
    """One row: accuracy, micro, macro and support-weighted precision, recall, F1 and IoU."""
    c = counts(cm)
    p = per_class(cm)
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    micro = c.agg(
        _ratio(tp, F.sum("support")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision_micro"),
        _ratio(tp, tp + fn).alias("recall_micro"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"),
    )
    names = ("precision", "recall", "f1", "iou")
    rest = p.agg(
        *[F.avg(n).alias(f"{n}_macro") for n in names],
        *[_ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(f"{n}_weighted") for n in names],
    )
    return micro.crossJoin(rest)


def binary(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: tn, fp, fn, tp, accuracy, f1 and iou of class 1."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    a = df.agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return a.select("tn", "fp", "fn", "tp", _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp + fn).alias("iou"))


def melted(metrics: DataFrame, ids=("cls",), values=("precision", "recall", "f1", "iou")) -> DataFrame:
    """(cls, variable, value)."""
    return metrics.unpivot(list(ids), list(values), "variable", "value")


def dice_parts(df: DataFrame, batch: str, truth: str = "cls", pred: str = "pred", ignore: int | None = None) -> DataFrame:
    """Partial TP/FP/FN by batch and class; partials add up to the final counts."""
    if ignore is not None:
        df = df.filter(F.col(truth) != ignore)
    t, p = F.col(truth), F.col(pred)
    e = df.select(batch, F.explode(F.when(t == p, F.array(t)).otherwise(F.array(t, p))).alias("cls"), t.alias("_t"), p.alias("_p"))
    return e.groupBy(batch, "cls").agg(
        F.count_if((F.col("_t") == F.col("cls")) & (F.col("_p") == F.col("cls"))).alias("tp"),
        F.count_if((F.col("_t") != F.col("cls")) & (F.col("_p") == F.col("cls"))).alias("fp"),
        F.count_if((F.col("_t") == F.col("cls")) & (F.col("_p") != F.col("cls"))).alias("fn"),
    )


def dice(parts: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(cls, dice, iou, dice_eps, iou_eps) from partial counts."""
    s = parts.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, wrong = F.col("tp"), F.col("fp") + F.col("fn")
    return s.select(
        "cls",
        _ratio(2 * tp, 2 * tp + wrong).alias("dice"),
        _ratio(tp, tp + wrong).alias("iou"),
        ((2 * tp + F.lit(eps)) / (2 * tp + wrong + F.lit(eps))).alias("dice_eps"),
        ((tp + F.lit(eps)) / (tp + wrong + F.lit(eps))).alias("iou_eps"),
    )
