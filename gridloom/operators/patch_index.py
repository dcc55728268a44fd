"""An index of patches by class: bitmaps of patch numbers, kept on disk and appended to.

A bitmap holds 32768 patch numbers, so the index is one small row for each class
and run of patches that holds it; a lookup reads the folders of its classes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "bucket long, bits binary, cls int"


def bitmaps(patches: DataFrame) -> DataFrame:
    """(bucket, bits, cls) of (patch_id, cls) pairs; repeated pairs count once, rows with a null or negative number are left out."""
    p = patches.filter("patch_id >= 0 and cls is not null").select(F.col("patch_id").cast("long").alias("p"), F.col("cls").cast("int").alias("cls"))
    g = p.select(F.expr("bitmap_bucket_number(p + 1)").alias("bucket"), F.expr("bitmap_bit_position(p + 1)").alias("at"), "cls")
    return g.groupBy("bucket", "cls").agg(F.expr("bitmap_construct_agg(at)").alias("bits")).select("bucket", "bits", "cls")


def append(patches: DataFrame, path: str) -> None:
    """Add the pairs of new patches; what is there is neither read nor written again."""
    bitmaps(patches).write.mode("append").partitionBy("cls").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, bits, cls), parts of several appends joined."""
    held = spark.read.schema(SCHEMA).parquet(path)
    return held.groupBy("bucket", "cls").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the index at ``path`` with one row for each class and bucket to ``to``."""
    read(spark, path).write.mode("overwrite").partitionBy("cls").parquet(to)


def counts(index: DataFrame) -> DataFrame:
    """(cls, n): patches that hold each class, without unpacking a bitmap."""
    return index.groupBy("cls").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))


def lookup(index: DataFrame, classes: list[int]) -> DataFrame:
    """(patch_id) of patches that hold any of ``classes``, each once."""
    held = index.filter(F.col("cls").isin([int(c) for c in classes])).groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    byte = F.posexplode(F.split(F.hex("bits"), "(?<=\\G..)")).alias("b", "h")
    held = held.select("bucket", byte).filter("h <> '00' and h <> ''").select("bucket", "b", F.conv("h", 16, 10).cast("int").alias("v"))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.expr("v").bitwiseAND(F.pow(F.lit(2), k).cast("int")) > 0)).alias("k")
    held = held.select("bucket", "b", bit)
    return held.select(((F.col("bucket") - 1) * 32768 + F.col("b") * 8 + F.col("k")).cast("long").alias("patch_id"))


def scan(patches: DataFrame, classes: list[int]) -> DataFrame:
    """The same from the patches themselves, where there is no index."""
    return patches.filter(F.col("cls").isin([int(c) for c in classes]) & (F.col("patch_id") >= 0)).select(F.col("patch_id").cast("long").alias("patch_id")).distinct()


def rare_patches(spark: SparkSession, patches: DataFrame, path: str, classes: list[int]) -> DataFrame:
    """(patch_id) of patches with any of ``classes`` by the index at ``path``; where there is none, by a scan."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return lookup(read(spark, path), classes)
    return scan(patches, classes)
