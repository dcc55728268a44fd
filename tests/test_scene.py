"""Scene processing against plain NumPy on small tiles; prediction by patches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import drivers, scene, scoring
from gridloom.sources import blocks, mappings

RNG = np.random.default_rng(5)
SIZES = {"B02": 12, "B03": 12, "B04": 12, "B08": 12, "B05": 6, "B01": 2}


def table(spark, tiles):
    rows = [(t, b, y, x, float(v)) for t, bands in tiles.items() for b, a in bands.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "tile string, band string, y int, x int, value double")


def shapes(spark, tiles):
    return spark.createDataFrame([(t, b, *a.shape) for t, bands in tiles.items() for b, a in bands.items()], "tile string, band string, height int, width int")


def keys(d):
    d = abs(d)
    return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0


def cubic(a, n):
    m = np.zeros((n, len(a)))
    for t in range(n):
        f = (t + 0.5) * len(a) / n - 0.5
        for k in range(-1, 3):
            s = int(np.floor(f)) + k
            m[t, min(max(s, 0), len(a) - 1)] += keys(f - s)
    return m @ a @ m.T


def want_band(bands, b, method):
    a = bands[b]
    n = max(len(v) for v in bands.values())
    if len(a) == n:
        return a
    r = cubic(a, n)
    if method == "brovey" and sum(k in bands for k in scene.FINE) >= 3:
        i = (bands["B04"] + bands["B03"] + bands["B02"]) / 3 if {"B02", "B03", "B04"} <= set(bands) else bands["B08"]
        return np.clip(r * i / i.mean(), a.min(), a.max())
    if method == "hpf" and "B08" in bands:
        p = np.pad(bands["B08"], 1, mode="symmetric")
        h = (10 * bands["B08"] - sum(p[dy : dy + n, dx : dx + n] for dy in range(3) for dx in range(3))) / 9
        return np.clip(r + 0.7 * (h - h.mean()), a.min(), a.max())
    return r


@pytest.mark.parametrize("method", ["simple", "brovey", "hpf"])
def test_sharpening_of_many_tiles(spark, method):
    tiles = {
        "T1": {b: RNG.uniform(100, 900, (n, n)) for b, n in SIZES.items()},
        "T2": {b: RNG.uniform(100, 900, (n, n)) for b, n in SIZES.items() if b not in ("B08",)},
        "T3": {b: RNG.uniform(100, 900, (n, n)) for b, n in SIZES.items() if b in ("B08", "B05")},
        "T4": {b: RNG.uniform(100, 900, (n, n)) for b, n in SIZES.items() if b not in ("B02",)},
    }
    got = {t: {b: np.full((12, 12), np.nan) for b in bands} for t, bands in tiles.items()}
    for r in scene.sharpen(table(spark, tiles), shapes(spark, tiles), method).collect():
        assert np.isnan(got[r["tile"]][r["band"]][r["y"], r["x"]])  # each pixel once
        got[r["tile"]][r["band"]][r["y"], r["x"]] = r["value"]
    for t, bands in tiles.items():
        for b in bands:
            np.testing.assert_allclose(got[t][b], want_band(bands, b, method), rtol=1e-9)


def test_unknown_method_is_refused(spark):
    with pytest.raises(ValueError):
        scene.sharpen(table(spark, {"T": {"B02": np.ones((2, 2))}}), shapes(spark, {"T": {"B02": np.ones((2, 2))}}), "other")


def test_two_tiles_side_by_side_make_one_scene(spark):
    tiles = {t: {b: RNG.uniform(100, 900, (n, n)) for b, n in SIZES.items()} for t in ("T1", "T2")}
    tiles["T1"]["B03"][4, 5] = 0.0  # nodata
    metas = None
    for t, x0 in (("T1", 0.0), ("T2", 80.0)):  # T2 starts at pixel 8, so 4 columns overlap
        for b, a in tiles[t].items():
            step = 120.0 / len(a)
            m = blocks.metadata(spark, *a.shape, origin=(x0, 120.0), step=(step, -step)).select(F.lit(t).alias("tile"), F.lit(b).alias("band"), "*")
            metas = m if metas is None else metas.union(m)
    target = blocks.metadata(spark, 12, 22, origin=(0.0, 120.0), step=(10.0, -10.0))
    cloud = spark.createDataFrame([("T2", 0, 20, True), ("T2", 0, 19, False)], "tile string, y int, x int, cloudy boolean")
    stack, valid, order = scene.process(table(spark, tiles), metas, target, "brovey", cloud=cloud)
    assert order == sorted(SIZES)
    got = {(r["y"], r["x"]): r["bands"] for r in stack.collect()}
    assert set(got) == {(y, x) for y in range(12) for x in range(20)}  # columns 20 and 21 lie outside both
    sharp = {t: np.stack([want_band(bands, b, "brovey") for b in order]) for t, bands in tiles.items()}
    for (y, x), v in got.items():
        np.testing.assert_allclose(v, sharp["T1"][:, y, x] if x < 12 else sharp["T2"][:, y, x - 8], rtol=1e-9)
    marks = {(r["y"], r["x"]): r["valid"] for r in valid.collect()}
    assert {k for k, v in marks.items() if not v} == {(4, 5)} and len(marks) == 240


def test_empty_scene(spark):
    none = table(spark, {"T": {"B02": np.ones((2, 2)), "B05": np.ones((1, 1))}}).limit(0)
    meta = blocks.metadata(spark, 2, 2).select(F.lit("T").alias("tile"), F.lit("B02").alias("band"), "*")
    stack, valid, order = scene.process(none, meta, blocks.metadata(spark, 2, 2))
    assert (stack.count(), valid.count(), order) == (0, 0, ["B02"])


def test_scene_check_and_ingest_plan(spark):
    a, b = (f"S2A_MSIL1C_2024010{i}T092401_N0510_R093_T34S{t}_20240101T000000" for i, t in ((1, "EH"), (2, "FH")))
    paths = [f"/d/{a}.SAFE/GRANULE/g/IMG_DATA/T34SEH_20240101T092401_{k}.jp2" for k in ("B02", "B8A")] + [f"/d/{b}.zip"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    meta = spark.createDataFrame([(a, "<x><Cloud_Coverage_Assessment>3</Cloud_Coverage_Assessment></x>", None, None), (b, None, None, 50.0)], "scene string, product_xml string, granule_xml string, mask_pct double")
    box = blocks.metadata(spark, 10, 10, origin=(0.0, 100.0)).select(F.lit(a).alias("scene"), F.lit("B02").alias("band"), "*")
    target = (50.0, 0.0, 150.0, 100.0)
    c = scene.check(files, meta, box, target)
    rows = {r["scene"]: r for r in c.collect()}
    assert (rows[a]["tile"], rows[a]["n_bands"], rows[a]["valid"], rows[a]["overlaps"], len(rows[a]["missing"])) == ("T34SEH", 2, True, True, 11)
    assert (rows[b]["needs_extract"], rows[b]["n_bands"], rows[b]["valid"], rows[b]["overlaps"], len(rows[b]["missing"])) == (True, 0, False, None, 13)
    use, covered = scene.ingest_plan(c, box, target)
    assert [r["scene"] for r in use.collect()] == [a] and covered.first()["share"] == 50.0


def test_patches_meet_the_scorer_whole(spark):
    class Patch:
        """Class 1 where a pixel exceeds its patch's mean: needs the patch together."""

        n_classes = 2

        def score(self, features):
            p = (features[:, 0] > features[:, 0].mean()).astype(float)
            return np.stack([1 - p, p], axis=1)

    a = RNG.uniform(0, 1, (8, 8))
    px = spark.createDataFrame([(y, x, [float(v)]) for (y, x), v in np.ndenumerate(a)], "y int, x int, features array<double>")
    got = {(r["y"], r["x"]): r["cls"] for r in scoring.predict(px, Patch(), 8, 8, 4, 0).collect()}
    want = {(y, x): int(v > a[y // 4 * 4 : y // 4 * 4 + 4, x // 4 * 4 : x // 4 * 4 + 4].mean()) for (y, x), v in np.ndenumerate(a)}
    assert got == want
    m = drivers.predict_map(px, Patch(), 8, 8, 4, 0, least=1, valid=px.select("y", "x", (F.col("y") > 0).alias("valid")))
    assert {r["cls"] for r in m.filter("y = 0").collect()} == {255} and m.count() == 64


def test_mapping_precedence(spark):
    rows = [("checkpoint", "/c/m.json", '{"remapper": {"class_mapping": {"5": 0}}}'), ("given", "/g/m.json", '{"6": 0}'), ("dataset", "/d/model_class_config.json", '{"class_mapping": {"7": 0}}'), ("dataset", "/d/class_mapping.json", '{"7": 0}')]
    for k, want in ((0, 5), (1, 6), (2, 7)):
        got = mappings.precedence(spark.createDataFrame(rows[k:], "kind string, path string, json string")).collect()
        assert [(r["orig"], r["idx"]) for r in got] == [(want, 0)]
    assert mappings.precedence(spark.createDataFrame(rows[3:], "kind string, path string, json string")).count() == 0


@pytest.mark.parametrize("reflect", [True, False])
@pytest.mark.parametrize("block,h", [(4, 19), (7, 19), (64, 19), (64, 2)])
def test_class_filters_by_blocks(spark, reflect, block, h):
    from gridloom.operators import focal

    w, r = 10, 3
    a = RNG.integers(0, 4, (h, w))
    held = RNG.random((h, w)) > 0.2  # the others aren't there
    px = spark.createDataFrame([(y, x, int(a[y, x]) * 10 if (y + x) % 11 else None) for y in range(h) for x in range(w) if held[y, x]], "y int, x int, cls int")
    run = focal.mean_filter_argmax if reflect else focal.majority_filter
    got = {(q["y"], q["x"]): q["cls"] for q in run(px, h, w, 2 * r + 1, block=block).collect()}
    p = np.pad(np.where(held & ((np.arange(h)[:, None] + np.arange(w)) % 11 != 0), a, -1), r, mode="symmetric" if reflect else "edge")
    for y in range(h):
        for x in range(w):
            n = np.bincount(p[y : y + 2 * r + 1, x : x + 2 * r + 1].ravel() + 1, minlength=5)[1:]
            assert got.pop((y, x), None) == (int(n.argmax()) * 10 if n.any() else None)
    assert not got


def test_class_filters_of_nothing(spark):
    from gridloom.operators import focal

    assert focal.smooth(spark.createDataFrame([], "y int, x int, cls int"), 9, 9).count() == 0
