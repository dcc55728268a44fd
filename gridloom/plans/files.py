"""Queries that write rasters of the tables as files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import runs, scoring
from gridloom.operators.warp import Grid
from gridloom.sources import blocks, tiff
from gridloom.sources.storage import files, scratch, store

from .classes import rounded
from .fixtures import R, TILES, WIDTH, height, literal, raster, tiles
from .registry import query
from .scene import CENTROIDS

#: Place of R on the ground: zone 34 north, 10 m pixels.
ORIGIN, STEP = (500_000.0, 4_200_000.0), (10.0, -10.0)


def grid(spark, sf_dir, **more):
    return blocks.metadata(spark, height(spark, sf_dir), WIDTH, origin=ORIGIN, step=STEP, **more)


def bands(r, names=("price", "cust", "cls")):
    """(band, y, x, value) of some columns of R."""
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in names])
    return r.select("y", "x", F.explode(pairs).alias("b")).select("b.band", "y", "x", "b.value")


def stored(spark, sf_dir):
    """R as tiled files of three bands; prices where status is P are nodata."""
    path, r = scratch(spark), raster(spark, sf_dir)
    r = r.withColumn("price", F.when(F.col("valid"), F.col("price")))
    tiff.write_tiff(bands(r), grid(spark, sf_dir, nodata=-1.0, tags={"classes": "water,field,town"}), path, bands=["price", "cust", "cls"])
    return path


_BANDS = "SELECT 'price' AS band, y, x, CASE WHEN valid THEN price END AS value FROM r UNION ALL SELECT 'cust', y, x, cust FROM r UNION ALL SELECT 'cls', y, x, CAST(cls AS DOUBLE) FROM r"


@query("tiff_round_trip", f"WITH {R} {_BANDS}")
def tiff_round_trip(spark, sf_dir):
    return tiff.read_tiff(spark, stored(spark, sf_dir))


@query("tiff_window", f"WITH {R} SELECT b.* FROM ({_BANDS}) b, h WHERE band <> 'cust' AND y >= h.h // 4 AND y < h.h // 2 AND x >= 10 AND x < 60")
def tiff_window(spark, sf_dir):
    """Two of the bands in a window, by filters pushed to the files."""
    h = height(spark, sf_dir)
    return tiff.read_tiff(spark, stored(spark, sf_dir), ["price", "cls"], (h // 4, h // 2, 10, 60))


@query("tiff_describe", f"""WITH {R} SELECT CAST(h.h AS INT) AS height, 100 AS width, 'EPSG:32634' AS crs, -1e0 AS nodata, 5e5 AS "left", 42e5 - 10 * h.h AS bottom, 501e3 AS "right", 42e5 AS top,
'water,field,town' AS classes, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT CAST(cls AS VARCHAR) AS v FROM r)) AS "values" FROM h""")
def tiff_describe(spark, sf_dir):
    """What the file's own header says, and the class ids that occur."""
    d = tiff.describe_tiff(spark, stored(spark, sf_dir), "cls")
    return d.drop("path").withColumns({c: F.array_join(c, ",") for c in ("classes", "values")})


@query("tiff_class_map", f"WITH {R} SELECT y, x, CASE WHEN valid THEN pred10 END AS a, CASE WHEN valid AND pred10 <> 0 THEN pred10 END AS b FROM r")
def tiff_class_map(spark, sf_dir):
    """Predicted classes as a byte map with nodata 255 (a) and as an int map with nodata 0 (b)."""
    r, like = raster(spark, sf_dir), grid(spark, sf_dir)
    classes = r.select("y", "x", F.when(F.col("valid"), F.col("pred10")).alias("cls"))
    out = []
    for name, nodata, dtype in (("a", 255, "u1"), ("b", 0, "i4")):
        path = scratch(spark)
        tiff.write_class_tiff(classes, like, path, nodata=nodata, dtype=dtype)
        out.append(tiff.read_tiff(spark, path).select("y", "x", F.col("value").cast("int").alias(name)))
    return out[0].join(out[1], ["y", "x"])


def _zipped(spark, folder, archive):
    """The files of a folder as one archive; the name of each gets the band's, as products have it."""
    import zipfile

    at, inner = store(archive)
    at.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with at.open_output_stream(inner) as o, zipfile.ZipFile(o, "w") as z:
        for f in files(folder, (".tif",)):
            source, path = store(f)
            with source.open_input_file(path) as i:
                z.writestr("P.SAFE/" + f[len(folder) + 1 :], i.read())
    return archive


_PREDICTED = f"""{R}, c AS (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))' for i, (a, b) in enumerate(CENTROIDS))}) t(cls, a, b)),
d AS (SELECT y, x, r.cls AS truth, c.cls, row_number() OVER (PARTITION BY y, x ORDER BY (cust / 1e3 - a) * (cust / 1e3 - a) + (price / 1e2 / 1e3 - b) * (price / 1e2 / 1e3 - b), c.cls) AS k FROM r, c),
m AS (SELECT y, x, truth, (cls + 1) * 10 AS cls FROM d WHERE k = 1)"""


def _run(spark, sf_dir, packed):
    """R as files of one band each, or as an archive of them, predicted into a map in files with the classes of R as truth."""
    r, at = raster(spark, sf_dir).withColumn("price", F.col("price") / 1e2), scratch(spark)
    for name in ("cust", "price"):
        tiff.write_tiff(bands(r, (name,)), grid(spark, sf_dir, nodata=-1.0), f"{at}/scene/{name}")
    tiff.write_class_tiff(r.select("y", "x", "cls"), grid(spark, sf_dir), f"{at}/truth")
    source = _zipped(spark, f"{at}/scene", f"{at}/scene.zip") if packed else f"{at}/scene"
    back = literal(spark, [((k + 1) * 10, k) for k in range(len(CENTROIDS))], "orig int, idx int")
    scorer = scoring.NearestCentroid(CENTROIDS)
    info = runs.predict(spark, source, scorer, f"{at}/out", bands=["cust", "price"], scale=1e3, size=32, overlap=8, mapping=back, truth=f"{at}/truth")
    return f"{at}/out", info


@query("predict_files", f"WITH {_PREDICTED} SELECT y, x, cls FROM m")
def predict_files(spark, sf_dir):
    """A folder of band files to a class map in a file, read back."""
    out, _ = _run(spark, sf_dir, False)
    return tiff.read_tiff(spark, f"{out}/prediction").select("y", "x", F.col("value").cast("int").alias("cls"))


@query("archive_to_map", f"""WITH {_PREDICTED}, l AS (SELECT DISTINCT truth AS cls FROM m UNION SELECT cls FROM m)
SELECT l.cls, round(coalesce(count_if(m.truth = l.cls AND m.cls = l.cls) / nullif(CAST(count_if(m.cls = l.cls) AS DOUBLE), 0), 0), 6) AS precision,
round(coalesce(count_if(m.truth = l.cls AND m.cls = l.cls) / nullif(CAST(count_if(m.truth = l.cls) AS DOUBLE), 0), 0), 6) AS recall, count_if(m.truth = l.cls) AS support FROM l, m GROUP BY l.cls""")
def archive_to_map(spark, sf_dir):
    """The same from an archive; what the run wrote about the classes."""
    out, _ = _run(spark, sf_dir, True)
    each = spark.read.option("header", "true").schema("cls int, precision double, recall double, f1 double, iou double, support long").csv(f"{out}/classes")
    return rounded(each.select("cls", "precision", "recall", "support"))


@query("ingest_archives", f"""WITH {TILES} SELECT y, x, arg_min(value, priority) FILTER (WHERE value IS NOT NULL) AS b0, arg_min(priority + 1e0, priority) FILTER (WHERE value IS NOT NULL) AS b1,
arg_min(value <> 0, priority) FILTER (WHERE value IS NOT NULL) AS valid FROM t GROUP BY y, x HAVING count(value) > 0""")
def ingest_archives(spark, sf_dir):
    """The tiles of R as archives of two band files each, ingested into one stack and its validity."""
    t, at = tiles(spark, sf_dir), scratch(spark)
    for k in range(3):
        one = t.filter(F.col("priority") == k)
        for name, value in (("B0", F.col("value")), ("B1", F.when(F.col("value").isNotNull(), F.col("priority") + 1e0))):
            tiff.write_tiff(one.select(F.lit(name).alias("band"), "y", "x", value.alias("value")), grid(spark, sf_dir, nodata=0.0), f"{at}/t{k}/{name}")
        _zipped(spark, f"{at}/t{k}", f"{at}/archives/t{k}.zip")
    g = Grid(height(spark, sf_dir), WIDTH, "EPSG:32634", *ORIGIN, *STEP)
    valid = runs.ingest(spark, f"{at}/archives", g, f"{at}/out")
    p = tiff.read_tiff(spark, f"{at}/out/stack").filter("value is not null")
    of = lambda b: F.max(F.when(F.col("band") == b, F.col("value")))
    return p.groupBy("y", "x").agg(of("B0").alias("b0"), of("B1").alias("b1")).join(valid, ["y", "x"])
