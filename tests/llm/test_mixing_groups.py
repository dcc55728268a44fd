"""Operator 5: every group has a multiplier of its own, gaps close, and what doesn't converge says so."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing


def table(spark, n, langs, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 60))), None if k % langs == 0 else f"l{k % langs}", f"s{int(rng.integers(0, 3))}") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)


def test_many_groups_are_drawn_to_their_shares(spark):
    """A hundred languages, null among them: each ends near its share of the mix; beyond the bound it raises."""
    docs = table(spark, 6000, 100)
    got = docs.join(mixing.planned(docs), "doc_id").withColumn("taken", F.col("size") * F.col("copies"))
    whole = got.agg(F.sum("size").alias("s"), F.sum("taken").alias("t")).first()
    by = got.groupBy("lang").agg(F.sum("size").alias("s"), F.sum("taken").alias("t")).collect()
    assert len(by) == 100
    off = [abs(r["t"] / whole["t"] - r["s"] / whole["s"]) * whole["t"] for r in by]
    assert np.mean(off) < 0.3 * whole["t"] / 100
    with pytest.raises(ValueError):
        mixing.planned(docs, most_groups=99)


def test_gaps_close_until_nothing_helps(spark):
    """Small documents everywhere: every source's tokens end within one word of its target."""
    got = mixing.planned(table(spark, 3000, 3, 1)).join(table(spark, 3000, 3, 1).select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("target")).collect():
        assert abs(r["t"] - r["target"]) <= 1


def test_a_cell_that_misses_its_target_raises(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_solved", lambda cells, target, cap: F.lit(0.1))
    with pytest.raises(ArithmeticError):
        mixing.planned(table(spark, 60, 2))
