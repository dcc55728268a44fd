"""Small helpers that the operators of this subpackage share.

Intermediate tables are written below the folder that the session names in
``spark.checkpoint.dir`` (shared by driver and executors), so lineage is cut by
data that survives a lost executor.  Only where the session names none and the
master is local, as in tests, a temporary folder of the driver is used.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"

#: Prefix of working columns that are joined to a caller's own columns.
OWN = "__gridloom_"

#: Rows up to which a side may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def free(name: str, columns: list[str]) -> str:
    """``name``, or with the prefix where a caller's column already has it."""
    return OWN + name if name.lower() in {c.lower() for c in columns} else name


def scratch(spark: SparkSession) -> str:
    """A new folder path below the shared checkpoint folder of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get()
    return f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


#: Spark's setting that removes an execution's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema.

    The shuffle files behind it are of no more use then and are removed.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._gridloom_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote and nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._gridloom_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the (already written) ``df`` has few rows.

    Beyond ``rows`` the frame is returned as it is and the join shuffles, with
    adaptive skew splitting for hot keys.
    """
    return F.broadcast(df) if df.count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="gridloom-"))
    target = os.path.join(folder, "gridloom_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(top, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._gridloom_shipped = True


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: columns node, component.

    component is the smallest node that is reachable.  Alternates large-star and
    small-star steps (each a groupBy with map-side minimum) until the edge set
    is stable; every round is written to the shared folder and the round before
    it deleted.  Nodes without an edge do not appear.  Empty edges give an empty
    frame.
    """
    e = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    before = None
    while True:
        # large star: every neighbour that is larger than u hangs below u's smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u and u itself hang below the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        nxt = small.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        ).distinct()
        last, e = e, materialise(nxt)
        discard(last)
        now = e.agg(
            F.count("*"),
            F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))"),
        ).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
