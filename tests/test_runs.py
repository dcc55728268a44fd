"""Whole runs from files to files on small rasters."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import runs, scoring, warp
from gridloom.sources import blocks, tiff

GRID = warp.Grid(40, 36, "EPSG:32634", 700_000.0, 4_000_000.0, 10.0, -10.0)
CENTRES = [[0.1, 0.2], [0.5, 0.6], [0.9, 0.1]]


def values(seed=0):
    """Two bands whose pixels lie near one of the centres, in stripes of it, and the class of each."""
    rng = np.random.default_rng(seed)
    cls = (np.add.outer(np.arange(40) // 8, np.arange(36) // 9) % 3).astype(int)
    return np.array(CENTRES)[cls] * 1000 + rng.normal(0, 20, (40, 36, 2)), cls


def put(spark, path, name, a, grid=GRID, nodata=-1.0):
    data = [(name, y, x, float(v)) for (y, x), v in np.ndenumerate(a)]
    tiff.write_tiff(spark.createDataFrame(data, "band string, y int, x int, value double"), runs.meta_of(spark, grid, nodata), path, tile=16, file_tiles=8)


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("scene")
    a, cls = values()
    for k, name in enumerate(("B02", "B03")):
        put(spark, str(at / "bands" / name), name, a[:, :, k])
    truth = spark.createDataFrame([(y, x, (int(c) + 1) * 10 if (y, x) != (0, 0) else None) for (y, x), c in np.ndenumerate(cls)], "y int, x int, cls int")
    tiff.write_class_tiff(truth, runs.meta_of(spark, GRID), str(at / "truth"))
    return at, a, cls


def test_sources_are_told_apart(spark, scene, tmp_path):
    at, a, _ = scene
    found = runs.layers(spark, str(at / "bands"))
    assert {l.bands for l in found} == {("B02",), ("B03",)} and {l.grid for l in found} == {GRID}
    meta = runs.meta_of(spark, GRID)
    blocks.write_raster(spark.createDataFrame([("B02", 0, 0, 1.0)], "band string, y int, x int, value double"), meta, str(tmp_path / "b"))
    l = runs.layers(spark, str(tmp_path / "b"))[0]
    assert (l.kind, l.bands, l.grid) == ("blocks", ("B02",), GRID) and l.pixels(spark).collect()[0]["value"] == 1.0
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.write(at / "bands/B02/r00000c00000.tif", "S.SAFE/x_B02.tif")
        z.writestr("S.SAFE/other.txt", "no raster")
    l = runs.layers(spark, str(tmp_path / "s.zip"), str(tmp_path / "w"))
    assert [x.bands for x in l] == [("B02",)] and l[0].pixels(spark).count() == 40 * 36
    with pytest.raises(FileNotFoundError):
        runs.layers(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("least", [None, 8])
def test_prediction_run(spark, scene, tmp_path, least):
    """The map, its metrics and what is said about it; post-processing sees original classes."""
    at, a, cls = scene
    mapping = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "orig int, idx int")
    out = str(tmp_path / "out")
    info = runs.predict(spark, str(at / "bands"), scoring.NearestCentroid(CENTRES), out, scale=1e3, size=16, overlap=4, mapping=mapping, least=least, truth=str(at / "truth"), model="centroids").first()
    got = {(r["y"], r["x"]): r["value"] for r in tiff.read_tiff(spark, f"{out}/prediction").collect()}
    assert len(got) == 40 * 36
    if least is None:
        assert got == {(y, x): (c + 1) * 10 for (y, x), c in np.ndenumerate(cls)} and info["metrics"]["accuracy"] == 1
    else:
        inner = [k for k in got if k[0] % 8 in (3, 4) and k[1] % 9 == 4]
        assert all(got[k] == (cls[k] + 1) * 10 for k in inner)
    told = json.loads(spark.read.text(f"{out}/info").first()["value"])
    assert (told["model"], told["height"], told["bands"], told["crs"]) == ("centroids", 40, ["B02", "B03"], "EPSG:32634")
    assert json.loads(spark.read.text(f"{out}/metrics").first()["value"])["accuracy"] == pytest.approx(info["metrics"]["accuracy"])
    assert spark.read.option("header", "true").csv(f"{out}/classes").count() == 3


def test_bands_of_other_grids_meet_the_truth(spark, scene, tmp_path):
    """A band in a coarser grid of another zone is warped to the truth's; predictions on other grids are scored there too."""
    at, a, cls = scene
    y, x = np.mgrid[0:60, 0:60]
    east = warp.covering_grid(GRID, "EPSG:32635", (20.0, -20.0))
    r, c = east.places(GRID, *np.mgrid[0 : east.height, 0 : east.width].astype(float))
    ri, ci = np.clip(np.round(r), 0, 39).astype(int), np.clip(np.round(c), 0, 35).astype(int)
    put(spark, str(tmp_path / "s/B03"), "B03", a[ri, ci, 1], east)
    put(spark, str(tmp_path / "s/B02"), "B02", a[:, :, 0])
    info = runs.predict(spark, str(tmp_path / "s"), scoring.NearestCentroid(CENTRES), str(tmp_path / "out"), scale=1e3, size=16, overlap=4, mapping=spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "orig int, idx int"), truth=str(at / "truth")).first()
    assert info["metrics"]["accuracy"] > 0.75 and info["height"] == 40
    _, whole, _ = runs.score(spark, str(at / "truth"), str(at / "truth"))
    assert whole.first()["accuracy"] == 1


def test_ingest_goes_on_and_merges(spark, scene, tmp_path):
    """Two overlapping scenes: the first by name answers for its pixels, lacking bands make a pixel invalid; a second run adds nothing anew."""
    at, a, _ = scene
    (tmp_path / "z").mkdir()
    for name, rows, bands in (("s1", range(0, 25), ("B02", "B03")), ("s2", range(15, 40), ("B02",))):
        for k, b in enumerate(bands):
            data = [(b, y, x, float(a[y, x, k]) + (1000 if name == "s2" else 0)) for y in rows for x in range(36) if (y, x) != (3, 3) or b == "B02"]
            tiff.write_tiff(spark.createDataFrame(data, "band string, y int, x int, value double"), runs.meta_of(spark, GRID, -1.0), str(tmp_path / name / b))
        with zipfile.ZipFile(tmp_path / "z" / f"{name}.zip", "w") as z:
            for b in bands:
                z.write(tmp_path / name / b / "r00000c00000.tif", f"{name}.SAFE/{b}.tif")
    out = str(tmp_path / "out")
    for _ in range(2):
        valid = {(r["y"], r["x"]): r["valid"] for r in runs.ingest(spark, str(tmp_path / "z"), GRID, out).collect()}
        assert valid == {(y, x): (y, x) != (3, 3) for y in range(40) for x in range(36)}
        got = {(r["band"], r["y"], r["x"]): r["value"] for r in tiff.read_tiff(spark, f"{out}/stack").filter("value is not null").collect()}
        want = {("B02", y, x): a[y, x, 0] + (1000 if y >= 25 else 0) for y in range(40) for x in range(36)}
        want |= {("B03", y, x): a[y, x, 1] for y in range(25) for x in range(36) if (y, x) != (3, 3)}
        assert got == pytest.approx(want)
    v = {(r["y"], r["x"]): r["value"] for r in tiff.read_tiff(spark, f"{out}/validity").collect()}
    assert sum(v.values()) == 40 * 36 - 1
