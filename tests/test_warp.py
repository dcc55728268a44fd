"""Warping between coordinate systems against plain loops and other formulas."""

import math

import numpy as np
import pytest

from gridloom.operators import warp
from gridloom.sources import blocks, tiff


def test_northing_is_the_meridian_arc():
    """On the central meridian the northing is the scaled length of the arc, here by Simpson's rule."""
    e2 = warp.FLATTENING * (2 - warp.FLATTENING)
    for latitude in (0.5, 12.0, 38.0, 61.5, 83.0):
        f = np.linspace(0, math.radians(latitude), 20_001)
        g = warp.SEMI_MAJOR * (1 - e2) / (1 - e2 * np.sin(f) ** 2) ** 1.5
        arc = (f[1] - f[0]) / 3 * (g[0] + g[-1] + 4 * g[1:-1:2].sum() + 2 * g[2:-1:2].sum())
        x, y = warp.System.of("EPSG:32634").from_degrees(21.0, latitude)
        assert abs(x - 500_000) < 1e-6 and abs(y - 0.9996 * arc) < 1e-4


def test_eastings_by_the_power_series():
    """Off the meridian: the series in powers of the longitude difference, to its own precision."""
    e2 = warp.FLATTENING * (2 - warp.FLATTENING)
    p2 = e2 / (1 - e2)
    for longitude, latitude in ((22.5, 38.0), (19.0, -20.0), (23.9, 60.0)):
        lat = math.radians(latitude)
        n = warp.SEMI_MAJOR / math.sqrt(1 - e2 * math.sin(lat) ** 2)
        t, c = math.tan(lat) ** 2, p2 * math.cos(lat) ** 2
        a = math.radians(longitude - 21.0) * math.cos(lat)
        x = 0.9996 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * p2) * a**5 / 120)
        assert abs(warp.System.of("EPSG:32634").from_degrees(longitude, latitude)[0] - 500_000 - x) < 0.02


def test_there_and_back():
    rng = np.random.default_rng(3)
    for code in ("EPSG:32601", "EPSG:32634", "EPSG:32760", "EPSG:4326"):
        s = warp.System.of(code)
        longitude = (s.meridian() if s.zone else 0) + rng.uniform(-4, 4, 500)
        latitude = rng.uniform(-80, 0, 500) if s.south else rng.uniform(0, 84, 500)
        back = s.to_degrees(*s.from_degrees(longitude, latitude))
        assert np.abs(np.array(back) - [longitude, latitude]).max() < 1e-9
    with pytest.raises(ValueError):
        warp.System.of("EPSG:3857")


def plain(held, source, target, method):
    """Every target pixel by itself; ``held`` is {(y, x): value}."""
    out = {}
    for y in range(target.height):
        for x in range(target.width):
            r, c = (float(v) for v in target.places(source, float(y), float(x)))
            if not (-0.5 <= r < source.height - 0.5 and -0.5 <= c < source.width - 0.5):
                continue
            if method == "nearest":
                v = held.get((math.floor(r + 0.5), math.floor(c + 0.5)))
                if v is not None:
                    out[y, x] = v
                continue
            total = weight = 0.0
            for i in (math.floor(r), math.floor(r) + 1):
                for j in (math.floor(c), math.floor(c) + 1):
                    w, v = (1 - abs(r - i)) * (1 - abs(c - j)), held.get((i, j))
                    if v is not None and w > 0:
                        total, weight = total + w * v, weight + w
            if weight > 0:
                out[y, x] = total / weight
    return out


SOURCE = warp.Grid(41, 53, "EPSG:32634", 700_000.0, 4_000_000.0, 10.0, -10.0)


def pixels(spark, source):
    held = {(y, x): math.sin(y / 7) * 50 + x for y in range(source.height) for x in range(source.width) if (y * 5 + x) % 17}
    rows = [("b", "k", y, x, v) for (y, x), v in held.items()] + [("b", "k", 3, 14, None), ("b", "k", 99, 0, 1.0)]
    return held, spark.createDataFrame(rows, "band string, sy string, y int, x int, value double").repartition(3)


@pytest.mark.parametrize("method", ["bilinear", "nearest"])
@pytest.mark.parametrize("code,step", [("EPSG:32635", (10.0, -10.0)), ("EPSG:32635", (7.0, -13.0)), ("EPSG:4326", (1e-4, -1e-4)), ("EPSG:32634", (10.0, -10.0))])
def test_against_a_loop(spark, method, code, step):
    """Blocks smaller than the raster, coarser and finer targets, degrees, holes; the same grid gives the same values."""
    held, df = pixels(spark, SOURCE)
    target = warp.covering_grid(SOURCE, code, step)
    got = {(r["y"], r["x"]): r["value"] for r in warp.warp(df, SOURCE, target, method=method, block=16).collect()}
    want = plain(held, SOURCE, target, method)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if code == SOURCE.crs:
        assert want == pytest.approx(held)


def test_to_another_zone_and_back(spark):
    """A smooth raster comes back within what two bilinear passes lose."""
    held = {(y, x): 20 * math.sin(y / 9) + 20 * math.cos(x / 11) for y in range(41) for x in range(53)}
    df = spark.createDataFrame([("b", y, x, v) for (y, x), v in held.items()], "band string, y int, x int, value double")
    east = warp.covering_grid(SOURCE, "EPSG:32635", (10.0, -10.0))
    there = warp.warp(df, SOURCE, east, block=32)
    back = {(r["y"], r["x"]): r["value"] for r in warp.warp(there, east, SOURCE, block=32).collect()}
    inner = [k for k in held if 3 <= k[0] < 38 and 3 <= k[1] < 50]
    assert all(abs(back[k] - held[k]) < 0.15 for k in inner)


def test_files_and_empty_tables(spark, tmp_path):
    """From file to file; a raster on the grid already is the same; nothing gives nothing."""
    held, df = pixels(spark, SOURCE)
    meta = lambda g: blocks.metadata(spark, g.height, g.width, crs=g.crs, origin=(g.x0, g.y0), step=(g.dx, g.dy), nodata=-5.0)
    tiff.write_tiff(df, meta(SOURCE), str(tmp_path / "a"), tile=16, file_tiles=2)
    assert warp.raster_grid(tiff.read_tiff_meta(spark, str(tmp_path / "a")))[0] == SOURCE
    warp.align_file(spark, str(tmp_path / "a"), meta(SOURCE), str(tmp_path / "same"))
    value = lambda p: {(r["y"], r["x"]): r["value"] for r in tiff.read_tiff(spark, str(tmp_path / p)).collect()}
    assert value("same") == value("a")
    target = warp.covering_grid(SOURCE, "EPSG:32635", (10.0, -10.0))
    warp.align_file(spark, str(tmp_path / "a"), meta(target), str(tmp_path / "b"), tile=16)
    want = plain(held, SOURCE, target, "bilinear")
    assert {k: v for k, v in value("b").items() if v is not None} == pytest.approx(want)
    assert warp.warp(df.limit(0), SOURCE, target).count() == 0
