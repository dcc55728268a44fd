"""A Spark data source for ``.npy`` arrays and a writer for patch datasets.

``spark.dataSource.register(NpySource)`` and then
``spark.read.format("npy").load("folder/*.npy")`` gives (path, y, x, band,
value) rows; with ``option("layout", "block")`` one row per file with its shape
and its values as an array.  Files are the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        if self.options.get("layout") == "block":
            return "path string, shape array<int>, values array<double>"
        return "path string, y int, x int, band int, value double"

    def reader(self, schema):
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.options["path"], recursive=True))]

    def read(self, partition):
        import numpy as np

        a = np.load(partition.value, allow_pickle=False)
        if self.options.get("layout") == "block":
            yield partition.value, [int(n) for n in a.shape], a.astype(float).ravel().tolist()
            return
        import pyarrow as pa

        cube = a[None] if a.ndim == 2 else a  # bands, rows, columns
        height, width = cube.shape[1:]
        step = max(1, 100_000 // max(width, 1))
        for k in range(cube.shape[0]):
            for y in range(0, height, step):  # some rows of a band at a time
                v = cube[k, y : y + step].astype(float)
                ys, xs = np.divmod(np.arange(v.size), width)
                columns = [pa.array([partition.value] * v.size), pa.array((ys + y).astype(np.int32)), pa.array(xs.astype(np.int32)), pa.array(np.full(v.size, k, np.int32)), pa.array(v.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "y", "x", "band", "value"])


def read_npy(spark, path: str) -> DataFrame:
    """(path, shape, payload) of ``.npy`` files in any store that Spark reads, decoded in Arrow batches."""
    import pyarrow as pa

    def rows(batches):
        import io

        import numpy as np

        for b in batches:
            out = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                a = np.load(io.BytesIO(c), allow_pickle=False)
                out.append({"path": p, "shape": [int(n) for n in a.shape], "values": a.astype(float).ravel()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("shape", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(rows, "path string, shape array<int>, values array<double>")


def write_patches(patches: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A patch dataset partitioned by split; nothing that exists is deleted unless ``mode`` says so."""
    patches.write.mode(mode).partitionBy("split").parquet(path)


def unpaired(images: DataFrame, masks: DataFrame, key: str = "name") -> DataFrame:
    """(key, side) of images without a mask and masks without an image."""
    a = images.join(masks, key, "left_anti").select(key, F.lit("image").alias("side"))
    return a.union(masks.join(images, key, "left_anti").select(key, F.lit("mask").alias("side")))
