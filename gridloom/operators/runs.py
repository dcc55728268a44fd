"""Whole runs from files to files: opening scenes of any kind, ingest, prediction, scoring.

Rasters stay distributed from the tiles read to the tiles written; the driver sees
the metadata of files, names of scenes and one-row results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import drivers, metrics, scene, scoring
from gridloom.operators.warp import Grid, warp
from gridloom.sources import blocks, sinks, tiff, zips
from gridloom.sources.storage import files, scratch

TIFF = (".tif", ".tiff")


@dataclass(frozen=True)
class Layer:
    """A raster of one or more bands on one grid: ``path`` is a file, or a folder of the files it was cut into."""

    path: str
    kind: str
    bands: tuple[str, ...]
    grid: Grid
    nodata: float | None

    def pixels(self, spark: SparkSession) -> DataFrame:
        """(band, y, x, value), nodata as null."""
        if self.kind == "blocks":
            return blocks.read_raster(spark, self.path)
        p = tiff.read_tiff(spark, self.path)
        own = dict(zip((f"b{k + 1}" for k in range(len(self.bands))), self.bands))
        name = F.coalesce(F.create_map(*[F.lit(v) for kv in own.items() for v in kv])[F.col("band")], F.col("band")) if own else F.col("band")
        return p.withColumn("band", name)


def _unzipped(spark: SparkSession, path: str, work: str) -> str:
    zips.unpack(spark, path, work, pattern=r"(?i)\.tiff?$")
    return work


def _blocks(spark: SparkSession, path: str) -> list[Layer]:
    m = blocks.read_meta(spark, path)
    bands = sorted(r["band"] for r in spark.read.parquet(f"{path}/pixels").select("band").distinct().collect())
    return [Layer(path, "blocks", tuple(bands), Grid.of(m), m.first()["nodata"])]


def _named(path: str, bands: list[str]) -> tuple[str, ...]:
    """Band names of a file; one without a name of its own has that of the file, the last part of ``..._B04.tif``."""
    if bands == ["b1"]:
        return (path.rsplit("/", 1)[-1].rsplit("_", 1)[-1].split(".")[0],)
    return tuple(bands)


def _tiffs(spark: SparkSession, path: str) -> list[Layer]:
    """One layer for every file, or for all files of a folder that hold the same bands."""
    groups: dict[tuple, list] = {}
    for r in tiff.read_tiff_meta(spark, path).orderBy("path").collect():  # a row a file
        folder = r["path"].rsplit("/", 1)[0]
        named = _named(r["path"], r["bands"])
        groups.setdefault((folder, named, r["crs"], r["dx"], r["dy"], r["raster"]), []).append(r)
    folders = [k[0] for k in groups]
    out = []
    for (folder, named, *_), rows in groups.items():
        one, whole = rows[0], rows[0]["raster"]
        if len(rows) > 1 and folders.count(folder) > 1:
            raise ValueError(f"{folder} mixes rasters of several files")
        at = one["path"] if len(rows) == 1 else folder
        if whole:  # pixels have its numbers, and of its files those without a pixel are not there
            out.append(Layer(at, "tiff", named, Grid(whole["height"], whole["width"], one["crs"], whole["x0"], whole["y0"], one["dx"], one["dy"]), one["nodata"]))
            continue
        if len(rows) == 1:
            out.append(Layer(at, "tiff", named, Grid(*[one[c] for c in ("height", "width", "crs", "x0", "y0", "dx", "dy")]), one["nodata"]))
            continue
        x0, y0 = (min(rows, key=lambda r: r[c] * (1 if r[d] > 0 else -1))[c] for c, d in (("x0", "dx"), ("y0", "dy")))
        size = [max(round((r[c] - o) / r[d]) + r[n] for r in rows) for c, o, d, n in (("y0", y0, "dy", "height"), ("x0", x0, "dx", "width"))]
        out.append(Layer(folder, "tiff", named, Grid(*size, one["crs"], x0, y0, one["dx"], one["dy"]), one["nodata"]))
    return out


def layers(spark: SparkSession, path: str, work: str | None = None) -> list[Layer]:
    """The rasters at ``path``: a TIFF file, a folder of such, a block raster, or a zip archive (unpacked below ``work``)."""
    if path.lower().endswith(".zip"):
        return layers(spark, _unzipped(spark, path, work or scratch(spark)))
    if files(path, TIFF):
        return _tiffs(spark, path)
    if files(f"{path}/meta", (".parquet",)):
        return _blocks(spark, path)
    raise FileNotFoundError(f"no raster at {path}")


def finest(found: list[Layer]) -> Grid:
    """The grid of the smallest pixels, the first by path of several."""
    return min(found, key=lambda l: (abs(l.grid.dx * l.grid.dy), l.path)).grid


def on_grid(spark: SparkSession, found: list[Layer], grid: Grid, method: str = "bilinear") -> DataFrame:
    """(band, y, x, value) of all layers on ``grid``; those that lie on it already are as they were."""
    out = None
    for l in found:
        p = l.pixels(spark)
        p = p if l.grid == grid else warp(p, l.grid, grid, method=method)
        p = p.select("band", "y", "x", F.col("value").cast("double").alias("value"))
        out = p if out is None else out.unionByName(p)
    return out


def meta_of(spark: SparkSession, grid: Grid, nodata: float | None = None, tags: dict | None = None) -> DataFrame:
    return blocks.metadata(spark, grid.height, grid.width, nodata=nodata, crs=grid.crs, origin=(grid.x0, grid.y0), step=(grid.dx, grid.dy), tags=tags)


def vectors(pixels: DataFrame, bands: list[str], scale: float) -> DataFrame:
    """(y, x, features): band values over ``scale`` in the order of ``bands``, absent ones 0, of pixels with any value."""
    of = lambda b: F.max(F.when(F.col("band") == b, F.col("value")))
    stack = pixels.filter("value is not null").groupBy("y", "x").agg(F.array(*[of(b) for b in bands]).alias("v"))
    return stack.select("y", "x", scene.band_vector(F.col("v"), scale).alias("features"))


def ingest(spark: SparkSession, archives: str, reference: Grid, out: str, *, method: str = "bilinear", nodata: float = 0.0) -> DataFrame:
    """Unpack, align, merge and stack all scenes of the zip archives below ``archives``; (y, x, valid) of the merged scene.

    Every scene is written on the ``reference`` grid by itself (``out/aligned``), so
    a run that is repeated goes on where it stopped; scenes that don't meet the grid
    are empty there.  Of overlapping scenes the first by name that holds a pixel
    gives its bands; a pixel is valid where that scene has all of its bands and none
    is ``nodata``.  Written are ``out/stack`` (all bands) and ``out/validity``.
    """
    names = sorted(a.rsplit("/", 1)[-1].removesuffix(".zip") for a in files(archives, (".zip",)))
    counts: dict[str, int] = {}
    for name in names:
        here = f"{out}/aligned/{name}"
        if not files(here, TIFF):
            found = layers(spark, f"{archives}/{name}.zip", f"{out}/scenes/{name}")
            p = on_grid(spark, found, reference, method)
            tiff.write_tiff(p, meta_of(spark, reference, nodata), here, bands=sorted({b for l in found for b in l.bands}))
        m = tiff.read_tiff_meta(spark, here).select("bands").first()
        counts[name] = len(m["bands"]) if m else 0
    tiff.register(spark)
    p = spark.read.format("gridloom_tiff").load(f"{out}/aligned").filter("value is not null")
    p = p.withColumn("tile", F.element_at(F.split("path", "/"), -2)).select("tile", "band", "y", "x", "value")
    n = spark.createDataFrame(list(counts.items()), "tile string, n long")
    merged, valid = scene.merge(p, scene.tile_validity(p, n, nodata))
    tiff.write_tiff(merged, meta_of(spark, reference, nodata), f"{out}/stack", overwrite=True)
    v = valid.select(F.lit("valid").alias("band"), "y", "x", F.col("valid").cast("double").alias("value"))
    tiff.write_tiff(v, meta_of(spark, reference, tags={"description": "1 = valid, 0 = invalid"}), f"{out}/validity", dtype="u1", overwrite=True)
    return valid


def predict(
    spark: SparkSession, source: str, scorer, out: str, *, bands: list[str] | None = None, scale: float = 1e4, size: int = 64, overlap: int = 16,
    mapping: DataFrame | None = None, least: int | None = None, truth: str | None = None, nodata: int = 0, model: str = "",
) -> DataFrame:
    """From a scene (file, folder, block raster or archive) to ``out/prediction``; one row about it.

    The map lies on the grid of ``truth`` if that is given, else on the scene's
    finest; with ``truth`` the map is scored where that is above 0, into
    ``out/classes`` (CSV) and ``out/metrics`` (JSON).  ``out/info`` holds the row
    as JSON.  Patches, mapping and post-processing are those of
    :func:`drivers.predict_map`.
    """
    found = layers(spark, source)
    true = layers(spark, truth)[0] if truth else None
    grid = true.grid if true else finest(found)
    order = bands or sorted({b for l in found for b in l.bands})
    placed = on_grid(spark, found, grid)
    stacked = vectors(placed.repartition(scoring.parts(grid.height * grid.width * len(order), 1_000_000), "y", "x"), order, scale)
    m = drivers.predict_map(stacked, scorer, grid.height, grid.width, size, overlap, mapping=mapping, least=least)
    tiff.write_class_tiff(m, meta_of(spark, grid), f"{out}/prediction", nodata=nodata, overwrite=True)
    about = {"model": F.lit(model), "source": F.lit(source), "prediction": F.lit(f"{out}/prediction"), "bands": F.array(*[F.lit(b) for b in order]), "height": F.lit(grid.height), "width": F.lit(grid.width), "crs": F.lit(grid.crs)}
    info = spark.range(1).select(*[c.alias(k) for k, c in about.items()])
    if truth:
        each, whole, _ = score(spark, f"{out}/prediction", truth, nodata)
        sinks.write_csv(each.orderBy("cls"), f"{out}/classes", "overwrite")
        sinks.write_json_text(whole.select(F.to_json(F.struct("*")).alias("json")), f"{out}/metrics", "overwrite")
        info = info.crossJoin(F.broadcast(whole.select(F.struct("*").alias("metrics"))))  # one row each
    sinks.write_json_text(info.select(F.to_json(F.struct("*")).alias("json")), f"{out}/info", "overwrite")
    return info


def score(spark: SparkSession, prediction: str, truth: str, nodata: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per class, summary, confusion) of two class maps in files, where the truth is above 0.

    Maps on different grids meet on that of the truth, by the nearest pixel; a
    pixel that the prediction lacks counts as ``nodata``.
    """
    t, p = layers(spark, truth)[0], layers(spark, prediction)[0]
    cls = lambda l, c: on_grid(spark, [l], t.grid, "nearest").select("y", "x", F.col("value").cast("int").alias(c))
    both = cls(t, "cls").join(cls(p, "pred"), ["y", "x"], "left").select("cls", filled("pred", nodata))
    cm = metrics.confusion(metrics.scored_pixels(both))
    return metrics.per_class(cm), metrics.summary(cm), cm


def filled(col: str, value: int) -> Column:
    return F.coalesce(col, F.lit(value)).alias(col)
