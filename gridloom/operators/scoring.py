"""Scorers: a callable that turns feature vectors into class probabilities.

Networks stay outside; any object with ``score(features) -> probabilities``
(NumPy arrays, rows by features and rows by classes) plugs in and runs in Arrow
batches.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import radial_weight, soft_weight
from gridloom.operators import merge, tiles


class Scorer(Protocol):
    n_classes: int

    def score(self, features): ...


class NearestCentroid:
    """Probabilities fall with the squared distance to each class centroid."""

    def __init__(self, centroids: list[list[float]]):
        self.centroids, self.n_classes = centroids, len(centroids)

    def score(self, features):
        import numpy as np

        d = ((features[:, None, :] - np.asarray(self.centroids)[None]) ** 2).sum(axis=2)
        e = np.exp(d.min(axis=1, keepdims=True) - d)
        return e / e.sum(axis=1, keepdims=True)


def onnx_scorer(path: str, n_classes: int):
    """A scorer around an ONNX file, where onnxruntime is installed; each worker opens the file itself."""

    class Onnx:
        session = None

        def score(self, features):
            if self.session is None:
                import onnxruntime

                self.session = onnxruntime.InferenceSession(path)
            return self.session.run(None, {self.session.get_inputs()[0].name: features.astype("float32")})[0]

    scorer = Onnx()
    scorer.n_classes = n_classes
    return scorer


def apply(df: DataFrame, scorer: Scorer, key: str, features: str) -> DataFrame:
    """(key, probs array<double>)."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            f = np.stack([np.asarray(v, float) for v in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(scorer.score(f)), pa.list_(pa.float64()))], names=[key, "probs"])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(features).cast("array<double>")).mapInArrow(rows, f"{key} {kind}, probs array<double>")


def centroids(df: DataFrame, features: str, cls: str, clip: int = 6) -> DataFrame:
    """(cls, pos, mean) of array features, for classes and vector places."""
    e = df.select(F.col(cls).alias("cls"), F.posexplode(features).alias("pos", "v"))
    return e.groupBy("cls", "pos").agg(F.round(F.avg(F.col("v").cast("double")), clip).alias("mean"))


def centroid_scores(df: DataFrame, cents: DataFrame, key: str, features: str) -> DataFrame:
    """(key, cls, score): minus the squared distance to each class centroid, by columns alone."""
    e = df.select(key, F.posexplode(features).alias("pos", "v"))
    d = e.join(F.broadcast(cents), "pos")
    return d.groupBy(key, "cls").agg((-F.sum(F.pow(F.col("v").cast("double") - F.col("mean"), 2))).alias("score"))


def parts(rows: float, each: int = 400_000) -> int:
    """Number of partitions of some ``each`` rows, so that what a task sorts or groups doesn't grow with the raster."""
    return max(1, int(rows // each) + 1)


def predict(
    pixels: DataFrame, scorer: Scorer, height: int, width: int, size: int, overlap: int, features: str = "features", soft: bool = False
) -> DataFrame:
    """(y, x, cls, p): class of each pixel (y, x, features) from overlapping patches.

    A patch's pixels go to the scorer together, in row order (size * size of them
    at most); the patches' probabilities are merged by their radial (or ``soft``)
    weights, and the largest wins, the smallest class of ties.  Patches, and pixels
    with their probabilities, are dealt to partitions in proportion to the raster.
    """
    weight = soft_weight if soft else radial_weight
    c = tiles.cover(pixels.select("y", "x", F.col(features).cast("array<double>").alias("f")), height, width, size, overlap)
    placed = height * width * (size / (size - overlap)) ** 2
    c = c.withColumn("w", weight(F.col("dy"), F.col("dx"), size)).repartition(parts(placed), "y0", "x0")

    def score(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by([("y", "ascending"), ("x", "ascending")])
        p = np.asarray(scorer.score(np.array(t.column("f").to_pylist(), float)), float)
        n, k = p.shape
        again = lambda name: pa.array(np.repeat(t.column(name).to_numpy(), k))
        return pa.table({"y": again("y").cast("int32"), "x": again("x").cast("int32"), "cls": pa.array(np.tile(np.arange(k, dtype="int32"), n)), "p": pa.array(p.ravel()), "w": again("w")})

    probs = c.groupBy("y0", "x0").applyInArrow(score, "y int, x int, cls int, p double, w double")
    return merge.argmax(merge.weighted(probs.repartition(parts(placed * scorer.n_classes, 1_000_000), "y", "x")))
