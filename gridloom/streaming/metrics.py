"""Streams of scored pixels, training logs, scene files and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import metrics


def running_counts(stream: DataFrame, truth: str = "cls", pred: str = "pred") -> DataFrame:
    """Stateful TP, FP and FN by class; write in update or complete mode.

    State: one row a class.  Partials come from the same expression as the
    batch metric, so the final state equals it.
    """
    t, p = F.col(truth), F.col(pred)
    e = stream.select(F.explode(F.when(t == p, F.array(t)).otherwise(F.array(t, p))).alias("cls"), t.alias("_t"), p.alias("_p"))
    c = F.col("cls")
    return e.groupBy("cls").agg(
        F.count_if((F.col("_t") == c) & (F.col("_p") == c)).alias("tp"), F.count_if((F.col("_t") != c) & (F.col("_p") == c)).alias("fp"), F.count_if((F.col("_t") == c) & (F.col("_p") != c)).alias("fn")
    )


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped with their windows' state."""
    s = stream.withColumn(time, F.col(time).cast("timestamp"))
    return s.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def early_stopping(stream: DataFrame, patience: int = 10) -> DataFrame:
    """(run, epoch, best, waited, stopped) for a stream of (run, epoch, metric); state by run: best and waited.

    Epochs of a run are taken in order inside each batch.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames, state):
        best, waited = state.get if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("epoch").itertuples():
            better = best is None or r.metric > best
            best, waited = (r.metric, 0) if better else (best, waited + 1)
            out.append((key[0], int(r.epoch), float(best), waited, waited >= patience))
        state.update((best, waited))
        yield pd.DataFrame(out, columns=["run", "epoch", "best", "waited", "stopped"])

    return stream.groupBy("run").applyInPandasWithState(
        update, "run string, epoch int, best double, waited int, stopped boolean", "best double, waited int", "update", GroupStateTimeout.NoTimeout
    )


def log_every(stream: DataFrame, path: str, checkpoint: str, every: int = 10):
    """Append a summary of each ``every``-th micro-batch to ``path``; returns the started query."""

    def write(batch: DataFrame, number: int):
        if number % every == 0:
            batch.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files as they arrive: (path, length)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder)
    return s.select("path", "length")


def blocks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of block files, a few at a time, for chunk-by-chunk prediction with ``availableNow``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def final_dice(counts: DataFrame) -> DataFrame:
    """Dice and IoU by class from the counts a stream has left."""
    return metrics.dice(counts)
