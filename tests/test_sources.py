"""Sources, sinks, drivers and streams on small data of their own."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import classes, drivers, focal, metrics, normalize, raster
from gridloom.sources import arrays, blocks, scenes, sinks
from gridloom.streaming import metrics as streams

SF = "/root/testdata/sf0.001"


def grid(spark, height, width, value):
    return spark.createDataFrame([("B02", y, x, float(value(y, x))) for y in range(height) for x in range(width)], "band string, y int, x int, value double")


def test_block_raster_reads_bands_and_windows(spark, tmp_path):
    p = grid(spark, 30, 20, lambda y, x: y * 20 + x).unionByName(grid(spark, 30, 20, lambda y, x: x % 3).withColumn("band", F.lit("cls")))
    blocks.write_raster(p, blocks.metadata(spark, 30, 20, block=8, nodata=7.0, origin=(500.0, 900.0), tags={"classes": "a, b"}), f"{tmp_path}/r")
    got = blocks.read_raster(spark, f"{tmp_path}/r", ["B02"], (7, 18, 3, 9))
    want = {(y, x): (float(y * 20 + x)) for y in range(7, 18) for x in range(3, 9)}
    assert {(r["y"], r["x"]): r["value"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "by#" in plan
    assert blocks.read_raster(spark, f"{tmp_path}/r", ["B02"]).filter("value is null").count() == 1  # the nodata value
    d = blocks.describe(spark, f"{tmp_path}/r", "cls").first()
    assert (d["height"], d["width"], d["values"], d["tags"]) == (30, 20, [0, 1, 2], {"classes": "a, b"})
    b = blocks.bounds(blocks.read_meta(spark, f"{tmp_path}/r")).first()
    assert (b["left"], b["bottom"], b["right"], b["top"]) == (500.0, 600.0, 700.0, 900.0)


def test_scene_bounds_prefers_fine_bands(spark):
    m = blocks.metadata(spark, 10, 10)
    metas = m.withColumns({"scene": F.lit("s"), "band": F.lit("B01")}).union(m.withColumns({"x0": F.lit(50.0), "scene": F.lit("s"), "band": F.lit("B03")})).union(m.withColumns({"scene": F.lit("t"), "band": F.lit("B09")}))
    assert {(r["scene"], r["band"], r["left"]) for r in blocks.scene_bounds(metas, ["B02", "B03"]).collect()} == {("s", "B03", 50.0), ("t", "B09", 0.0)}


def test_class_maps_and_assembly(spark, tmp_path):
    cls = spark.createDataFrame([(0, 0, 5), (0, 1, None), (1, 0, 255)], "y int, x int, cls int")
    for nodata in (0, 255):
        blocks.write_class_map(cls, blocks.metadata(spark, 2, 2), f"{tmp_path}/{nodata}", nodata=nodata)
        kept = {(r["y"], r["x"]): r["value"] for r in blocks.read_raster(spark, f"{tmp_path}/{nodata}").collect()}
        assert kept == {(0, 0): 5.0, (0, 1): None, (1, 0): 255.0 if nodata == 0 else None}
    made = []

    def make():
        made.append(1)
        return grid(spark, 2, 2, lambda y, x: x), blocks.metadata(spark, 2, 2)

    for _ in range(2):
        assert blocks.assembled(spark, f"{tmp_path}/a", make).count() == 4
    assert made == [1]
    info = blocks.prediction_info(spark.range(1).select(F.lit(1).alias("n")), blocks.metadata(spark, 2, 3, crs="c"), "m").first()["json"]
    assert info == '{"model":"m","height":2,"width":3,"crs":"c","metrics":{"n":1}}'


def test_archives(spark, tmp_path):
    name = "S2A_MSIL1C_20240101T092401_N0510_R093_T34SEH_20240101T000000"
    with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
        z.writestr(f"in/{name}.SAFE/GRANULE/a.jp2", b"1")
        z.writestr(f"in/{name}.SAFE/MTD.xml", b"22")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = scenes.extract(spark, str(tmp_path))
    assert sorted((r["path"] or "", bytes(r["content"] or b"")) for r in got.collect()) == [("", b""), (f"in/{name}.SAFE/GRANULE/a.jp2", b"1"), (f"in/{name}.SAFE/MTD.xml", b"22")]
    folders = {r["archive"].rsplit("/", 1)[-1]: (r["folder"], r["complete"]) for r in scenes.product_folder(got).collect()}
    assert folders == {f"{name}.zip": (f"{name}.SAFE", True), "bad.zip": (None, False)}
    here = spark.createDataFrame([(name,)], "scene string")
    assert scenes.extract(spark, str(tmp_path), here).filter("path is not null").count() == 0


def test_file_choices(spark):
    f = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    paths = lambda d: sorted(r["path"] for r in d.collect())
    assert paths(scenes.mask_files(f("a_mask.tif", "b.tif", "c.tiff"))) == ["a_mask.tif"]
    assert paths(scenes.mask_files(f("c.tiff", "d.png"))) == ["c.tiff"]
    assert paths(scenes.with_image(f("/d/masks/1.npy", "/d/masks/2.npy"), f("/d/images/2.npy"))) == ["/d/masks/2.npy"]
    pairs = scenes.ordered_pairs(f("b1", "a1", "c1"), f("a2", "b2"))
    assert {(r["image"], r["mask"]) for r in pairs.collect()} == {("a1", "a2"), ("b1", "b2")}
    s = "/d/S2A_X.SAFE/GRANULE/g/QI_DATA/"
    assert paths(scenes.cloud_masks(f(s + "MSK_CLDPRB_20m.jp2", s + "MSK_CLASSI_B00.jp2", s + "other.jp2"))) == [s + "MSK_CLASSI_B00.jp2"]


def test_npy_source(spark, tmp_path):
    cube = np.arange(2 * 5 * 7, dtype=np.float32).reshape(2, 5, 7)
    np.save(tmp_path / "a.npy", cube)
    spark.dataSource.register(arrays.NpySource)
    got = spark.read.format("npy").load(f"{tmp_path}/*.npy").collect()
    assert {(r["band"], r["y"], r["x"]): r["value"] for r in got} == {(k, y, x): float(cube[k, y, x]) for k in range(2) for y in range(5) for x in range(7)}
    assert arrays.read_npy(spark, str(tmp_path)).first()["shape"] == [2, 5, 7]


def test_domain_flags(spark):
    def flags(*values):
        r = classes.domain_flags(spark.createDataFrame([(v,) for v in values], "cls int")).first()
        return r["consecutive"], r["sparse"], r["need_remap"]

    assert flags(1, 2, 3) == (True, False, True)
    assert flags(0, 1, 2) == (True, False, False)
    assert flags(0, 2) == (False, True, True)
    assert flags(-1, 1) == (False, False, True)


def test_positional_mapping_drops_nodata_and_pins_zero(spark):
    of = lambda *v: spark.createDataFrame([(x, x) for x in v], "pred int, cls int")
    pairs = lambda p, t: {r["pred"]: r["cls"] for r in classes.positional_mapping(of(*p), of(*t)).collect()}
    assert pairs((0, 1, 2, 255), (0, 10, 20)) == {0: 0, 1: 10, 2: 20}
    assert pairs((0, 1, 255), (10, 20)) == {0: 10, 1: 20}
    assert pairs((1, 2, 3), (0, 10)) == {1: 0, 2: 10, 3: 10}
    assert pairs((0, 1, 2), (0, 10)) == {0: 0, 1: 10, 2: 10}


def test_scale_and_clip_by_image(spark):
    d = spark.createDataFrame([(1, 50.0), (1, 20000.0), (2, 0.5), (2, 99.0), (2, -1.0)], "image int, value double")
    got = sorted((r["image"], r["value"]) for r in normalize.scale_and_clip(d, "image").collect())
    assert got == [(1, 0.005), (1, 1.0), (2, 0.0), (2, 0.5), (2, 1.0)]


def test_detection_and_history(spark):
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "cls int")
    assert tuple(classes.detect(of(0, 1, 1)).first()) == ([0, 1], 1)
    assert tuple(classes.detect(of(0, 2, None)).first()) == ([0, 2], 2)
    h = spark.createDataFrame([(2, 5, 6), (1, 3, 4)], "epoch int, a int, b int")
    assert sinks.columns_json(h, "epoch", ["a", "b"]).first()["json"] == '{"a":[3,5],"b":[4,6]}'


def flood(cells, diagonal):
    """Components of equal neighbours by plain search: cell -> smallest cell."""
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    comp = {}
    for s in sorted(cells):
        todo = [s] if s not in comp else []
        while todo:
            c = todo.pop()
            if c not in comp:
                comp[c] = s
                todo += [n for n in ((c[0] + a, c[1] + b) for a, b in near) if cells.get(n) == cells[c]]
    return comp


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_and_small_objects_against_a_search(spark, diagonal):
    rng = np.random.default_rng(3)
    cells = {(y, x): int(rng.integers(0, 2)) for y in range(14) for x in range(11)}
    df = spark.createDataFrame([(y, x, c) for (y, x), c in cells.items()], "y int, x int, cls int")
    want, groups = flood(cells, diagonal), {}
    for r in focal.components(df, diagonal).collect():
        groups.setdefault(r["comp"], set()).add(want[r["y"], r["x"]])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
    if not diagonal:
        size = {}
        for s in want.values():
            size[s] = size.get(s, 0) + 1
        got = {(r["y"], r["x"]): r["cls"] for r in focal.remove_small(df, 4).collect()}
        assert got == {c: (v if size[want[c]] >= 4 else 0) for c, v in cells.items()}


def test_cubic_resize_against_fixed_weights(spark):
    """Half-pixel centres, Keys' kernel of -0.5, clamped edges."""
    rng = np.random.default_rng(2)
    a = rng.random((6, 5))
    df = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(6) for x in range(5)], "y int, x int, value double")
    got = {(r["y"], r["x"]): r["value"] for r in raster.cubic(df, "value", 6, 5, 9, 8).collect()}

    def w(d):
        d = abs(d)
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else (-0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0)

    for y in range(9):
        for x in range(8):
            fy, fx = (y + 0.5) * 6 / 9 - 0.5, (x + 0.5) * 5 / 8 - 0.5
            ys, xs = int(np.floor(fy)), int(np.floor(fx))
            v = sum(w(fy - i) * w(fx - j) * a[min(max(i, 0), 5), min(max(j, 0), 4)] for i in range(ys - 1, ys + 3) for j in range(xs - 1, xs + 3))
            assert abs(got[y, x] - v) < 1e-9


def run_stream(df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


@pytest.fixture()
def scored(spark, tmp_path):
    from gridloom.plans import fixtures

    r = fixtures.raster(spark, SF).select("cls", F.col("pred10").alias("pred"))
    r.repartition(3).write.parquet(f"{tmp_path}/in")
    return r, f"{tmp_path}/in"


def test_running_counts_equal_the_batch(spark, scored):
    r, path = scored
    run_stream(streams.running_counts(spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(path)), "running_counts")
    got = {x["cls"]: (x["tp"], x["fp"], x["fn"]) for x in spark.table("running_counts").collect()}
    want = {x["cls"]: (x["tp"], x["fp"], x["fn"]) for x in metrics.counts(metrics.confusion(r)).collect()}
    assert got == want


def test_early_stopping_state(spark, tmp_path):
    log = [("a", e, m) for e, m in enumerate([1.0, 3.0, 2.0, 2.0, 4.0])] + [("b", e, 5.0 - e) for e in range(4)]
    spark.createDataFrame(log, "run string, epoch int, metric double").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("run string, epoch int, metric double").parquet(f"{tmp_path}/in")
    run_stream(streams.early_stopping(s, 2), "early_stopping", "update")
    got = {(r["run"], r["epoch"]): (r["best"], r["waited"], r["stopped"]) for r in spark.table("early_stopping").collect()}
    assert got[("a", 3)] == (3.0, 2, True) and got[("a", 4)] == (4.0, 0, False) and got[("b", 3)] == (5.0, 3, True)


def test_windowed_counts_and_blocks(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartition(2).write.parquet(f"{tmp_path}/in")
    s = streams.blocks(spark, f"{tmp_path}/in", ev.schema)
    run_stream(streams.windowed_counts(s, late="100000 days"), "windowed")
    got = {(r["window"]["start"], r["event_type"]): r["n"] for r in spark.table("windowed").collect()}
    want = ev.filter("ts is not null").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().collect()
    assert got == {(r["w"]["start"], r["event_type"]): r["count"] for r in want}


def test_log_every_and_new_scenes(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("value")).write.parquet(f"{tmp_path}/in")
    streams.log_every(spark.readStream.schema("value double").parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/c").awaitTermination(120)
    assert tuple(spark.read.parquet(f"{tmp_path}/log").select("n", "mean").first()) == (10, 4.5)
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.zip").write_bytes(b"abc")
    run_stream(streams.new_scenes(spark, f"{tmp_path}/z"), "new_scenes", "append")
    assert [r["length"] for r in spark.table("new_scenes").collect()] == [3]


def test_score_and_dataset_drivers(spark):
    truth = spark.createDataFrame([(0, x, 10 * (x % 3)) for x in range(9)], "y int, x int, cls int")
    pred = spark.createDataFrame([(0, x, 255 if x == 8 else x % 3) for x in range(1, 12)], "y int, x int, pred int")
    per, total, cm = drivers.score(pred, truth)
    assert {r["cls"]: (r["precision"], r["support"]) for r in per.collect()} == {10: (1.0, 3), 20: (1.0, 2)}
    assert total.first()["accuracy"] == 1.0
    px = spark.createDataFrame([(y, x, y // 8, not (y < 4 and x < 4), y * 16 + x) for y in range(16) for x in range(16)], "y int, x int, cls int, valid boolean, pixel_id long")
    patches, mapping = drivers.build_dataset(px, 16, 16, 8, 4, rare=[1])
    assert mapping.count() == 2 and patches.filter("split is null").count() == 0
    assert patches.select("y0", "x0").distinct().count() == patches.count() > 9
