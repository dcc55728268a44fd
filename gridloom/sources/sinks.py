"""JSON and CSV sinks; each is a one-row or small table written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records_json(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """One row, json: {name: [records in order]}; for metric and history tables, not for pixels."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))
    return df.agg(rows.alias("r")).select(F.to_json(F.struct(F.col("r").alias(name))).alias("json"))


def columns_json(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row, json: parallel lists by ``order``, as training histories are stored."""
    g = df.agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("r"))

    def column(c: str):
        return F.transform("r", lambda x: x[c]).alias(c)

    return g.select(F.to_json(F.struct(*[column(c) for c in columns])).alias("json"))


def splits_info(patches: DataFrame, size: int, bands: int) -> DataFrame:
    """One row: the counts of a split dataset with its patch size, bands and classes."""
    n = lambda s: F.count_if(F.col("split") == s).alias(f"{s}_patches")
    return patches.agg(n("train"), n("val"), n("test"), F.sort_array(F.collect_set("cls")).alias("class_values")).withColumns(
        {"patch_size": F.lit(size), "num_bands": F.lit(bands)}
    )


def class_config(mapping: DataFrame, ignore: int = -1) -> DataFrame:
    """One row: num_classes, class_values, ignore_index."""
    return mapping.agg(F.count("*").cast("int").alias("num_classes"), F.sort_array(F.collect_list("idx")).alias("class_values")).withColumn("ignore_index", F.lit(ignore))


def write_json_text(one: DataFrame, path: str, mode: str = "errorifexists") -> None:
    one.select("json").coalesce(1).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def overwrite_blocks(df: DataFrame, path: str, by=("by", "bx")) -> None:
    """Replace only the blocks that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
