"""Queries and operators on tables that outgrow the small fixtures: repeated keys, deep models, rasters of several files."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"


def repeated(folder, name, key, times):
    """A folder with the table repeated under shifted keys."""
    t = pq.read_table(f"{SF}/{name}.parquet")
    k = t.column(key).to_pylist()
    step = max(k) - min(k) + 1
    some = [t.set_column(t.column_names.index(key), key, pa.array([v + step * i for v in k], t.schema.field(key).type)) for i in range(times)]
    pq.write_table(pa.concat_tables(some), f"{folder}/{name}.parquet")
    return str(folder)


def test_deep_models_keep_their_row(spark, tmp_path):
    from gridloom.operators import training

    sf = repeated(tmp_path, "part", "p_partkey", 200)
    got = {r["model"]: r for r in registry.QUERIES["receptive_field"](spark, sf).collect()}
    simple = {r["model"] for r in registry.QUERIES["receptive_field_simple"](spark, sf).collect()}
    assert set(got) == simple and any(r["rf"] is None for r in got.values())
    layers = spark.createDataFrame([("deep", k, 3, 2) for k in range(40)] + [("flat", 0, 3, 1), ("flat", 1, 3, 1)], "model string, pos int, kernel int, stride int")
    rf = {r["model"]: (r["rf"], r["effective"]) for r in training.receptive_field(layers).collect()}
    deep = 1 + 2 * (2**40 - 1)
    assert rf == {"deep": (deep, deep * 2 // 3), "flat": (5, 3)}


def test_grids_know_their_size(spark):
    """A grid is as large to Spark as it is, so its joins are not broadcast by a guess."""
    from gridloom.operators import tiles

    size = lambda d: int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    for make, args in ((tiles.grid_floor, (32, 8)), (tiles.grid_clamp, (32, 8)), (tiles.grid_padded, (32, 8)), (tiles.chunk_grid, (40, 5))):
        grid = make(spark, 3_000_000, 100, *args)
        assert size(grid) >= 8 * grid.count() > 10**6


@pytest.mark.parametrize("height, width, chunk, halo", [(9, 7, 4, 1), (5, 11, 3, 5), (1, 1, 4, 2), (8, 8, 4, 0)])
def test_pixels_of_chunks(spark, height, width, chunk, halo):
    from gridloom.operators import tiles

    pixels = spark.createDataFrame([(y, x) for y in range(height) for x in range(width)], "y int, x int")
    chunks = tiles.chunk_grid(spark, height, width, chunk, halo)
    got = sorted((r["vy0"], r["vx0"], r["y"], r["x"], r["own"]) for r in tiles.in_chunks(pixels, chunks, chunk, halo).collect())
    want = sorted((c["vy0"], c["vx0"], y, x, c["vy0"] <= y < c["vy1"] and c["vx0"] <= x < c["vx1"]) for c in chunks.collect() for y in range(c["y0"], c["y1"]) for x in range(c["x0"], c["x1"]))
    assert got == want


@pytest.mark.parametrize("height, width, size, overlap", [(40, 35, 12, 3), (3, 50, 12, 3), (9, 9, 8, 2), (1, 1, 8, 3)])
def test_mirrored_places_of_padded_windows(spark, height, width, size, overlap):
    from gridloom.operators import tiles

    fold = lambda i, n: -i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i
    pixels = spark.createDataFrame([(y, x) for y in range(height) for x in range(width)], "y int, x int")
    windows = [(r["y0"], r["x0"]) for r in tiles.grid_padded(spark, height, width, size, overlap).collect()]
    places = [(y0, x0, dy, dx, fold(y0 + dy - overlap, height), fold(x0 + dx - overlap, width)) for y0, x0 in windows for dy in range(size) for dx in range(size)]
    want = sorted(p for p in places if 0 <= p[4] < height and 0 <= p[5] < width)
    got = sorted((r["y0"], r["x0"], r["dy"], r["dx"], r["y"], r["x"]) for r in tiles.in_padded(pixels, height, width, size, overlap).collect())
    assert got == want


def test_a_raster_of_several_files_is_one(spark, tmp_path):
    """Described, opened and ingested as a whole, also where its first and last files hold no pixel."""
    from gridloom.operators import runs, warp
    from gridloom.operators.warp import Grid
    from gridloom.sources import blocks, tiff

    path, meta = str(tmp_path / "r"), blocks.metadata(spark, 100, 20, nodata=-1.0, origin=(5e5, 42e5), tags={"classes": "a,b"})
    data = [("cls", y, x, float(y // 10)) for y in range(35, 66) for x in range(20)]
    tiff.write_tiff(spark.createDataFrame(data, "band string, y int, x int, value double"), meta, path, tile=16, file_tiles=1)
    assert tiff.read_tiff_meta(spark, path).count() == 6
    d = tiff.describe_tiff(spark, path, "cls").collect()
    assert [tuple(r) for r in d] == [(path, 100, 20, "EPSG:32634", -1.0, 5e5, 42e5 - 1000, 5e5 + 200, 42e5, ["a", "b"], [3, 4, 5, 6])]
    grid = Grid(100, 20, "EPSG:32634", 5e5, 42e5, 10.0, -10.0)
    (layer,) = runs.layers(spark, path)
    assert layer.grid == grid == warp.raster_grid(tiff.read_tiff_meta(spark, path))[0]
    got = {(r["y"], r["x"]): r["value"] for r in runs.on_grid(spark, [layer], grid).filter("value is not null").collect()}
    assert got == {(y, x): v for _, y, x, v in data}
    (one,) = runs.layers(spark, tiff.read_tiff_meta(spark, path).orderBy("path").first()["path"])
    assert one.grid == grid


def test_equal_polygons_are_swept_once(spark):
    """Copies of polygons change nothing about the cover, nor the work."""
    import time

    from pyspark.sql import functions as F

    from gridloom.operators import geometry

    box = spark.range(400).select(geometry.turned_box(F.col("id") % 5 * 2.0, F.floor(F.col("id") % 25 / 5) * 2.0, F.lit(1.5), F.lit(1.5), F.lit(0.5)).alias("ring"))
    target = [(0, 0), (10, 0), (10, 10), (0, 10)]
    few = geometry.polygon_coverage(box.limit(25), target).first()
    began = time.time()
    many = geometry.polygon_coverage(spark.range(10).crossJoin(box).select("ring"), target).first()
    assert time.time() - began < 30
    assert [round(v, 9) for v in few] == [round(v, 9) for v in many]


def test_prediction_is_dealt_by_the_size_of_the_raster(spark):
    from gridloom.operators import scoring

    pixels = spark.createDataFrame([(0, 0, [1.0]), (9, 9, [2.0])], "y int, x int, features array<double>")
    dealt = [scoring.predict(pixels, scoring.NearestCentroid([[1.0], [2.0]]), h, 100, 32, 8).rdd.getNumPartitions() for h in (20_000, 200_000)]
    assert dealt[1] >= 8 * dealt[0] > 8


def test_frequent_words_outlive_a_full_memo():
    from gridloom.llm import tokens

    with open(tokens.default_path(), encoding="utf-8") as f:
        enc = tokens.WordEncoder(f.read(), 40)
    asked, plain = [], enc._word
    enc._word = lambda w: asked.append(w) or plain(w)
    for k in range(200):
        text = f"river stone w{k}x"
        want = enc.tok.encode(text, add_special_tokens=False).ids
        assert enc.encode(text) == b"".join(i.to_bytes(4, "little") for i in want)
    assert asked.count(b"river") == 1 and len(enc.words) <= 20


def test_texts_are_encoded_together_and_pieces_looked_up_once(monkeypatch):
    import random

    import pyarrow as pa
    from gridloom.llm import tokens

    with open(tokens.default_path(), encoding="utf-8") as f:
        enc = tokens.WordEncoder(f.read())
    bits = ["river", "River", "É", "straße", "ÿ!", "K", "Á", "H̱", "٣", "7", "42", "don't", "'s", "'", "...", ",", "<|"]
    bits += ["<|endoftext|>", "|>", "\x00", "\x1f", "\xa0", " ", "漢字", "🙂", "×", "µ", "…", "`{", "[]", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x85"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(600)] + [None, "", " \n ", "river " * 300]
    want = [b"".join(i.to_bytes(4, "little") for i in enc.tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    array = pa.array(["cut off", *texts]).slice(1)
    assert list(enc.encode_all(array)) == want
    assert list(enc.encode_all(array.cast(pa.large_string()))) == want
    monkeypatch.setattr(tokens, "SLICE", 40)  # many slices, and texts longer than one
    assert list(enc.encode_all(array)) == want
    assert list(enc.encode_all(array.slice(0, 0))) == [] and list(enc.encode_all(pa.array([None, " "], pa.string()))) == [b"", b""]

    monkeypatch.setattr(tokens, "SLICE", 1_000_000)
    asked, plain = [], enc._piece
    enc._piece = lambda p: asked.append(p) or plain(p)
    assert len(list(enc.encode_all(pa.array(["River stone, river; STONE"] * 500)))) == 500
    assert sorted(asked) == sorted({"river", "stone", "", ",", ";"})
