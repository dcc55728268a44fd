"""Tables around training: early stopping, selection, schedules, receptive fields."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def early_stopping(log: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric", patience: int = 10) -> DataFrame:
    """Adds best (running), improved, waited (epochs since the last improvement) and stopped."""
    w = W.partitionBy(run).orderBy(epoch)
    before = F.max(metric).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = log.withColumn("improved", before.isNull() | (F.col(metric) > before)).withColumn("best", F.max(metric).over(w))
    d = d.withColumn("_island", F.sum(F.col("improved").cast("int")).over(w))
    waited = F.row_number().over(W.partitionBy(run, "_island").orderBy(epoch)) - 1
    d = d.withColumn("waited", waited)
    over = F.max((F.col("waited") >= patience).cast("int")).over(w) == 1
    return d.withColumn("stopped", over).drop("_island")


def best_run(log: DataFrame, run: str = "run", metric: str = "metric") -> DataFrame:
    """One row: the run of the largest metric, the first name of ties."""
    return log.groupBy(run).agg(F.max(metric).alias(metric)).orderBy(F.desc(metric), run).limit(1)


def schedules(spark: SparkSession, epochs: int, lr: float, min_lr: float = 1e-6, step: int = 10, gamma: float = 0.1, warm: float = 0.3, div: float = 25.0, final_div: float = 1e4) -> DataFrame:
    """(epoch, cosine, step_lr, onecycle) in closed form."""
    e = F.col("epoch").cast("double")
    cosine = min_lr + (lr - min_lr) * (1 + F.cos(e * math.pi / epochs)) / 2
    up = warm * epochs - 1
    low, end = lr / div, lr / div / final_div
    rise = low + (lr - low) * (1 - F.cos(e / up * math.pi)) / 2
    fall = end + (lr - end) * (1 + F.cos((e - up) / (epochs - 1 - up) * math.pi)) / 2
    return spark.range(epochs).select(
        F.col("id").cast("int").alias("epoch")
    ).select("epoch", cosine.alias("cosine"), (lr * F.pow(F.lit(gamma), F.floor(e / step))).alias("step_lr"), F.when(e <= up, rise).otherwise(fall).alias("onecycle"))


def unfreeze_schedule(spark: SparkSession, epochs: int, shares=(0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """(stage, epoch): when each further block of the backbone is trained."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.floor(F.lit(epochs * s)).cast("int").alias("epoch")) for i, s in enumerate(shares)])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.stage", "r.epoch")


def learning_rates(groups: DataFrame, base: float, encoder_factor: float) -> DataFrame:
    """(group, kind) -> lr: the encoder learns at a fraction of the rate."""
    return groups.withColumn("lr", F.when(F.col("kind") == "encoder", base * encoder_factor).otherwise(F.lit(base)))


def config_grid(lrs: DataFrame, factors: DataFrame, schedulers: DataFrame) -> DataFrame:
    """All combinations, named; three small tables."""
    g = lrs.crossJoin(factors).crossJoin(schedulers)
    return g.withColumn("name", F.concat_ws("_", F.lit("exp"), F.col("lr").cast("string"), F.col("factor").cast("string"), F.col("scheduler")))


def receptive_field(layers: DataFrame, model: str = "model", order: str = "pos") -> DataFrame:
    """(model, rf, effective): rf grows by (kernel - 1) * jump, jump by stride, over (model, pos, kernel, stride).

    Strides below 1 stand for upsampling.  effective: two thirds of rf, rounded down.
    Both are doubles, as rf doubles with every stride of 2 and outgrows any integer type.
    """
    s = F.sort_array(F.collect_list(F.struct(order, "kernel", "stride")))
    start = F.struct(F.lit(1e0).alias("rf"), F.lit(1e0).alias("jump"))
    step = lambda a, l: F.struct((a["rf"] + (l["kernel"] - 1) * a["jump"]).alias("rf"), (a["jump"] * l["stride"]).alias("jump"))
    r = layers.groupBy(model).agg(F.aggregate(s, start, step)["rf"].alias("rf"))  # a row a layer of a model
    part = F.col("rf") * 2 / 3
    return r.select(model, "rf", F.when(part < 2.0**53, F.floor(part).cast("double")).otherwise(part).alias("effective"))  # larger ones are whole


def receptive_field_simple(layers: DataFrame, model: str = "model") -> DataFrame:
    """(model, rf): 1 plus (kernel - 1) * factor of every layer (model, kernel, factor), without a running jump."""
    return layers.groupBy(model).agg((1 + F.sum((F.col("kernel") - 1) * F.col("factor"))).cast("int").alias("rf"))


def results(log: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """(run, epochs, best, best_epoch): a row a run; of equal metrics the first epoch."""
    top = F.max(F.struct(F.col(metric), (-F.col(epoch)).alias("e")))
    g = log.groupBy(run).agg(F.count("*").alias("epochs"), top.alias("t"))
    return g.select(run, "epochs", F.col(f"t.{metric}").alias("best"), (-F.col("t.e")).cast("int").alias("best_epoch"))


#: Keys of a configuration that may be absent, with their defaults.
OPTIONAL = {"min_lr": 1e-6, "factor": 0.1, "patience": 5.0}


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """(name, learning_rate, encoder, scheduler, min_lr, factor, patience) of JSON files: one object a line.

    Absent optional keys get :data:`OPTIONAL`; lines that aren't objects and those
    without a name are left out.
    """
    kinds = "name string, learning_rate double, encoder string, scheduler string, " + ", ".join(f"{k} double" for k in OPTIONAL)
    c = spark.read.schema(kinds).json(path).filter("name is not null")
    return c.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in OPTIONAL.items()})


def encoders(spark: SparkSession, known: dict[str, tuple[int, ...]]) -> DataFrame:
    """(encoder, stages, channels) of a registry: the channels of each stage, and of the last."""
    rows = F.array(*[F.struct(F.lit(k).alias("encoder"), F.array(*map(F.lit, v)).alias("stages")) for k, v in known.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*").withColumn("channels", F.element_at("stages", -1))
