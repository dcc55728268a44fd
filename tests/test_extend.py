"""Normalizer stages, metrics of one's own, the patch index and augmentation on awkward input."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from gridloom.operators import augment, estimators, patch_index, split, training

NAN = float("nan")
BANDS = "band string, value double"


def test_normalizers_survive_a_reload(spark, tmp_path):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("a", NAN), ("b", 7.0), (None, 1.0)]
    df = spark.createDataFrame(rows, BANDS)
    model = Pipeline(stages=[estimators.BandNormalizer(method="standard"), estimators.BandNormalizer(method="minmax", outputCol="m")]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    more = spark.createDataFrame([*rows, ("c", 1.0)], BANDS)
    same = lambda a, b: a is b is None or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b))))
    got, want = (m.transform(more).collect() for m in (model, PipelineModel.load(str(tmp_path / "m"))))
    assert all(same(x["normalized"], y["normalized"]) and same(x["m"], y["m"]) for x, y in zip(got, want))
    of = {(r["band"], r["value"]): (r["normalized"], r["m"]) for r in got if r["value"] is None or r["value"] == r["value"]}
    assert of["a", 1.0] == (-1.0, 0.0) and of["a", 3.0] == (1.0, 1.0) and of["b", 7.0] == (0.0, 0.0) and of["c", 1.0] == (None, None) and of["a", None] == (None, None)


def test_normalizers_of_positive_values_and_of_nothing(spark):
    df = spark.createDataFrame([("a", -5.0), ("a", 0.0), ("a", 2.0), ("a", 4.0)], BANDS)
    got = {r["value"]: r["normalized"] for r in estimators.BandNormalizer(method="positive").fit(df).transform(df).collect()}
    assert got == {-5.0: -8.0, 0.0: -3.0, 2.0: -1.0, 4.0: 1.0}
    nothing = estimators.BandNormalizer().fit(df.limit(0))
    assert [r["normalized"] for r in nothing.transform(df).collect()] == [None] * 4
    with pytest.raises(ValueError):
        estimators.BandNormalizer(method="other")


def test_metric_states_add_up(spark, tmp_path):
    data = [(k % 3, int(v), int(p)) for k, (v, p) in enumerate(np.random.default_rng(0).integers(0, 3, (60, 2)))]
    df = spark.createDataFrame(data, "g int, cls int, pred int").withColumn("k", F.monotonically_increasing_id())
    m = estimators.Metric("precision_of_1", {"tp": "count_if(cls = 1 and pred = 1)", "all": "count_if(pred = 1)"}, "tp / nullif(all, 0)")
    m.save(spark, str(tmp_path / "m"))
    assert estimators.Metric.load(spark, str(tmp_path / "m")) == m
    parts = [m.state(df.filter(F.expr(f"pmod(hash(k), 3) = {i}")), "g") for i in (2, 0, 1)]
    got = {r["g"]: r["precision_of_1"] for r in m.result(m.merged(*parts, by=("g",)), "g").collect()}
    for g in range(3):
        mine = [(v, p) for k, v, p in data if k == g]
        assert got[g] == pytest.approx(sum(v == p == 1 for v, p in mine) / sum(p == 1 for _, p in mine))
    assert m.result(m.merged(m.state(df.limit(0)))).first()[0] is None
    estimators.register(m)
    r = estimators.evaluate(df, ["accuracy", "precision_of_1"]).first()
    assert r["accuracy"] == pytest.approx(sum(v == p for _, v, p in data) / 60)
    del estimators.REGISTRY[m.name]


def test_index_and_scan_agree_after_appends(spark, tmp_path):
    rng, path = np.random.default_rng(1), str(tmp_path / "i")
    pairs = [(int(p), int(c)) for p, c in zip(rng.integers(0, 140_000, 3000), rng.integers(0, 5, 3000))] + [(0, 9), (32767, 9), (32768, 9), (65536, 9)]
    df = spark.createDataFrame([*pairs, *pairs[:50], (None, 1), (3, None), (-4, 1)], "patch_id long, cls int")
    whole = lambda d: sorted(r[0] for r in d.collect())
    assert whole(patch_index.rare_patches(spark, df, path, [9])) == [0, 32767, 32768, 65536]  # no index yet
    for k in range(3):
        patch_index.append(df.filter(F.expr(f"coalesce(patch_id, 0) % 3 = {k}")), path)
        patch_index.append(df.limit(0), path)
    for classes in ([9], [1, 4], [7], [], [0, 1, 2, 3, 4, 9]):
        assert whole(patch_index.rare_patches(spark, df, path, classes)) == whole(patch_index.scan(df, classes)) == sorted({p for p, c in pairs if c in classes})
    assert {r["cls"]: r["n"] for r in patch_index.counts(patch_index.read(spark, path)).collect()} == {c: len({p for p, k in pairs if k == c}) for c in {c for _, c in pairs}}
    patch_index.compact(spark, path, f"{path}2")
    assert whole(patch_index.lookup(patch_index.read(spark, f"{path}2"), [9, 2])) == whole(patch_index.scan(df, [9, 2]))


def plain(a, m, n, d):
    """One patch, pixel by pixel."""
    fold = lambda i: 0 if n == 1 else min(abs(i) % (2 * n - 2), 2 * n - 2 - abs(i) % (2 * n - 2))
    c, out, mask = (n - 1) / 2, np.zeros_like(a), np.zeros_like(m)
    for i in range(n):
        for j in range(n):
            y, x = i - c - d["down"] * n, j - c - d["right"] * n
            y, x = (math.cos(d["angle"]) * y - math.sin(d["angle"]) * x) / d["zoom"], (math.sin(d["angle"]) * y + math.cos(d["angle"]) * x) / d["zoom"]
            for _ in range(d["turns"]):
                y, x = x, -y
            r, s = (-y if d["vflip"] else y) + c, (-x if d["hflip"] else x) + c
            for k in range(len(a)):
                for p in (math.floor(r), math.floor(r) + 1):
                    for q in (math.floor(s), math.floor(s) + 1):
                        out[k, i, j] += (1 - abs(r - p)) * (1 - abs(s - q)) * a[k, fold(p), fold(q)]
            mask[i, j] = m[fold(math.floor(r + 0.5)), fold(math.floor(s + 0.5))]
    return out * d["gain"] + d["lift"], mask


def test_augmentation_against_a_loop(spark):
    """Every draw occurs; partitioning changes nothing; null patches and masks stay null."""
    n, rng = 7, np.random.default_rng(5)
    data = [(k, rng.normal(size=(2, n, n)), rng.integers(0, 4, (n, n))) for k in range(60)]
    rows = [(k, a.reshape(2, -1).tolist(), m.ravel().tolist()) for k, a, m in data] + [(900, None, [1] * 49), (901, [[0.5] * 49], None)]
    df = spark.createDataFrame(rows, "id long, bands array<array<double>>, mask array<int>")
    ranges = augment.Ranges(affine=0.6)
    got = {r["id"]: r for r in augment.augment(df.repartition(5), n, "id", ranges=ranges).collect()}
    again = {r["id"]: r for r in augment.augment(df.coalesce(1), n, "id", ranges=ranges).collect()}
    assert got == again and got[900]["bands"] is None and got[901]["mask"] is None
    draws = {r["id"]: r.asDict() for r in augment.drawn(df, "id", ranges).collect()}
    assert {draws[k]["turns"] for k in range(60)} == {0, 1, 2, 3} and len({draws[k]["angle"] for k in range(60)}) > 20
    for k, a, m in data:
        want, mask = plain(a, m, n, draws[k])
        assert np.allclose(np.array(got[k]["bands"]).reshape(2, n, n), want) and got[k]["mask"] == mask.ravel().tolist()
    other = {r["id"]: r for r in augment.augment(df, n, "id", ranges=ranges, seed=100).collect()}
    assert sum(other[k] != got[k] for k in range(60)) > 40
    with pytest.raises(ValueError):
        augment.augment(df.withColumn("angle", F.lit(0)), n, "id")
    assert augment.augment(df.limit(0), n, "id").count() == 0


def test_configurations_and_splits(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"name": "a", "learning_rate": 0.1, "factor": 0.5}\n{"learning_rate": 1}\nnonsense\n{"name": "b", "patience": 3, "more": 1}\n')
    got = {r["name"]: (r["learning_rate"], r["factor"], r["patience"], r["min_lr"]) for r in training.read_configs(spark, str(tmp_path)).collect()}
    assert got == {"a": (0.1, 0.5, 5.0, 1e-6), "b": (None, 0.1, 3.0, 1e-6)}
    parts = [spark.createDataFrame([(1, s)], "k int, split string") for s in ("train", "val")]
    assert [tuple(r) for r in split.recombine(parts).collect()] == [(1,), (1,)]
