"""Streams that keep state by key, and streams that rewrite their blocks exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.sinks import overwrite_blocks
from gridloom.sources.storage import ship

RUN_STATE = "run string, epoch int, best double, waited int, status string"


def watch_runs(stream: DataFrame, patience: int = 10, stall: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(run, epoch, best, waited, status) of a training log (run, epoch, metric, ts); status: running, stopped or stalled.

    State by run: best metric, epochs since then, last epoch.  A run is stopped
    once ``patience`` epochs brought nothing better and gives no more rows; one
    without a row for ``stall`` of event time gives a row stalled by a timer, and its
    state is dropped.  Epochs are taken in order inside a batch; a null metric is
    an epoch that is no better.  Needs the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    limit = int(stream.sparkSession.sql(f"SELECT CAST(unix_millis(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {stall}) AS BIGINT)").first()[0])

    class Watch(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.held = handle.getValueState("held", "best double, waited int, epoch int, stopped boolean")

        def handleInputRows(self, key, rows, timerValues):
            best, waited, last, stopped = self.held.get() if self.held.exists() else (None, 0, None, False)
            out, newest = [], 0
            for r in pd.concat(list(rows)).sort_values("epoch").itertuples():
                newest = max(newest, int(r.ts.timestamp() * 1000))
                if stopped:
                    continue
                better = r.metric == r.metric and r.metric is not None and (best is None or r.metric > best)
                best, waited, last = (float(r.metric), 0, int(r.epoch)) if better else (best, waited + 1, int(r.epoch))
                stopped = waited >= patience
                out.append((key[0], last, best, waited, "stopped" if stopped else "running"))
            self.held.update((best, waited, last, stopped))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if not stopped:
                self.handle.registerTimer(newest + limit)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RUN_STATE.split(", ")])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            best, waited, last, _ = self.held.get()
            self.held.clear()
            yield pd.DataFrame([(key[0], last, best, waited, "stalled")], columns=[c.split()[0] for c in RUN_STATE.split(", ")])

        def close(self):
            pass

    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return s.groupBy("run").transformWithStateInPandas(Watch(), outputStructType=RUN_STATE, outputMode="Append", timeMode="EventTime")


def keyed_state(spark: SparkSession) -> None:
    """The state store that :func:`watch_runs` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def predict_chunks(chunks: DataFrame, pixels: DataFrame, scorer, out: str, checkpoint: str):
    """Score a raster (y, x, features) chunk by chunk as the stream ``chunks`` (``tiles.chunk_grid``) names them; the started query.

    A chunk is read with its halo and scored in row order; what it owns is
    written to its own folder of ``out``, which replaces what was there.  So a
    batch that is run again, after a failure or a restart, leaves every pixel once.
    """

    def score(key, t):
        import numpy as np
        import pyarrow as pa

        vy0, vy1, vx0, vx1 = (k.as_py() for k in key)
        t = t.sort_by([("y", "ascending"), ("x", "ascending")])
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        best = np.asarray(scorer.score(np.array(t.column("f").to_pylist(), float)), float).argmax(axis=1)
        own = (y >= vy0) & (y < vy1) & (x >= vx0) & (x < vx1)
        n = int(own.sum())
        return pa.table([pa.array([vy0] * n, pa.int32()), pa.array([vx0] * n, pa.int32()), pa.array(y[own].astype("int32")), pa.array(x[own].astype("int32")), pa.array(best[own].astype("int32"))], names=["by", "bx", "y", "x", "cls"])

    ship(pixels.sparkSession)
    held = pixels.select("y", "x", F.col("features").cast("array<double>").alias("f"))

    def write(batch: DataFrame, number: int):
        c = batch.select("*", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
        inside = c.join(held, "y").filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
        done = inside.select("vy0", "vy1", "vx0", "vx1", "y", "x", "f").groupBy("vy0", "vy1", "vx0", "vx1").applyInArrow(score, "by int, bx int, y int, x int, cls int")
        overwrite_blocks(done, out)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
