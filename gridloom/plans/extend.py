"""Queries: normalizer stages, metrics of one's own, the index of rare patches, augmentation, configurations."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from gridloom.operators import augment, blend, estimators, patch_index, training
from gridloom.sources.storage import scratch

from .classes import rounded
from .fixtures import R, V, WIDTH, event_classes, height, patch_labels, raster, table
from .registry import query

_BANDED = "e AS (SELECT vec_id, CAST(unnest(range(0, 64)) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE len(embedding) = 64), f AS (SELECT *, concat('b', pos % 4) AS band FROM e)"


@query("ml_normalizer", f"WITH {_BANDED} SELECT vec_id, pos, round((v - avg(v) OVER (PARTITION BY band)) / stddev_pop(v) OVER (PARTITION BY band), 6) AS standard, round((v - min(v) OVER (PARTITION BY band)) / (max(v) OVER (PARTITION BY band) - min(v) OVER (PARTITION BY band)), 6) AS minmax FROM f")
def ml_normalizer(spark, sf_dir):
    """Places of the vectors as four bands, normalized by a pipeline of two stages that was saved and loaded."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    e = e.select("vec_id", "pos", F.concat(F.lit("b"), F.col("pos") % 4).alias("band"), F.col("v").cast("double").alias("value"))
    path = scratch(spark)
    stages = [estimators.BandNormalizer(method=m, outputCol=m) for m in ("standard", "minmax")]
    Pipeline(stages=stages).fit(e).write().overwrite().save(path)
    return rounded(PipelineModel.load(path).transform(e).select("vec_id", "pos", "standard", "minmax"))


@query("custom_metric", f"""WITH {R}, k AS (SELECT cls // 10 AS g, count_if(valid AND pred10 = cls) AS hit, count_if(valid) AS n, sum(abs(cls - pred10)) AS off, count(*) AS m FROM r GROUP BY 1)
SELECT CAST(g AS INT) AS g, round(CAST(hit AS DOUBLE) / n, 6) AS valid_accuracy, round(CAST(off AS DOUBLE) / m, 6) AS mean_distance FROM k""")
def custom_metric(spark, sf_dir):
    """Two metrics of one's own, stored and loaded; their states come from two halves of R and are merged."""
    r = raster(spark, sf_dir).withColumn("g", F.expr("cast(cls div 10 as int)"))
    made = [
        estimators.Metric("valid_accuracy", {"hit": "count_if(valid and pred10 = cls)", "n": "count_if(valid)"}, "hit / nullif(n, 0)"),
        estimators.Metric("mean_distance", {"off": "sum(abs(cls - pred10))", "n": "count(*)"}, "off / nullif(n, 0)"),
    ]
    out = None
    for m in made:
        path = scratch(spark)
        m.save(spark, path)
        m = estimators.Metric.load(spark, path)
        halves = [m.state(r.filter(F.col("pixel_id") % 2 == k), "g") for k in (0, 1)]
        one = m.result(m.merged(*halves, by=("g",)), "g")
        out = one if out is None else out.join(one, "g")
    return rounded(out)


@query("metric_registry", f"WITH {R} SELECT CAST(y % 5 AS INT) AS g, round(avg(CAST(cls = pred10 AS INT)), 6) AS accuracy, round(CAST(count_if(cls > 0 AND cls = pred10) AS DOUBLE) / count_if(cls > 0 OR pred10 > 0), 6) AS iou_foreground FROM r GROUP BY 1")
def metric_registry(spark, sf_dir):
    r = raster(spark, sf_dir).select((F.col("y") % 5).alias("g"), "cls", F.col("pred10").alias("pred"))
    return rounded(estimators.evaluate(r, ["accuracy", "iou_foreground"], "g"))


@query("rare_index", f"WITH {V}, k AS (SELECT cls FROM vc ORDER BY n, cls LIMIT 2) SELECT DISTINCT patch_id FROM v WHERE cls IN (SELECT cls FROM k)")
def rare_index(spark, sf_dir):
    """Users with an event of one of the two rarest classes, from an index that was written in two parts."""
    v, path = event_classes(spark, sf_dir), scratch(spark)
    patch_index.append(v.filter(F.col("patch_id") % 2 == 0), path)
    patch_index.append(v.filter(F.col("patch_id") % 2 == 1), path)
    rare = [r["cls"] for r in v.groupBy("cls").count().orderBy("count", "cls").limit(2).collect()]
    return patch_index.rare_patches(spark, v, path, rare)


@query("rare_index_counts", f"WITH {V} SELECT cls, count(DISTINCT patch_id) AS n FROM v GROUP BY cls")
def rare_index_counts(spark, sf_dir):
    """Patches by class, counted from the stored bitmaps alone."""
    path = scratch(spark)
    patch_index.append(event_classes(spark, sf_dir), path)
    return patch_index.counts(patch_index.read(spark, path))


def _u(k):
    return f"CAST(concat('0x', substr(md5(concat('{k}:', CAST(vec_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296e0"


_TAKEN = "p.vec_id = a.vec_id AND p.y = CASE WHEN abs(floor(a.r) + i.d) > 7 THEN 14 - abs(floor(a.r) + i.d) ELSE abs(floor(a.r) + i.d) END AND p.x = CASE WHEN abs(floor(a.c) + j.d) > 7 THEN 14 - abs(floor(a.c) + j.d) ELSE abs(floor(a.c) + j.d) END"


@query("augment_patches", f"""WITH p AS (SELECT vec_id, CAST(unnest(range(0, 64)) // 8 AS INT) AS y, CAST(unnest(range(0, 64)) % 8 AS INT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE len(embedding) = 64),
d AS (SELECT vec_id, {_u(1)} < 5e-1 AS hflip, {_u(2)} < 5e-1 AS vflip, CASE WHEN {_u(3)} < 5e-1 THEN floor({_u(4)} * 4) ELSE 0 END AS turns, {_u(5)} < 2e-1 AS moved, radians((2 * {_u(6)} - 1) * 10) AS angle,
 1 + (2 * {_u(7)} - 1) * 5e-2 AS zoom, (2 * {_u(8)} - 1) * 625e-4 AS down, (2 * {_u(9)} - 1) * 625e-4 AS "right", {_u(10)} < 5e-1 AS toned, 1 + (2 * {_u(11)} - 1) * 2e-1 AS gain, (2 * {_u(12)} - 1) * 2e-1 AS lift FROM embeddings),
s AS (SELECT d.*, p.y AS ty, p.x AS tx, p.y - 35e-1 - CASE WHEN moved THEN down * 8 ELSE 0 END AS y0, p.x - 35e-1 - CASE WHEN moved THEN "right" * 8 ELSE 0 END AS x0 FROM d JOIN p ON p.vec_id = d.vec_id),
t AS (SELECT *, CASE WHEN moved THEN (cos(angle) * y0 - sin(angle) * x0) / zoom ELSE y0 END AS y1, CASE WHEN moved THEN (sin(angle) * y0 + cos(angle) * x0) / zoom ELSE x0 END AS x1 FROM s),
q AS (SELECT *, CASE turns WHEN 0 THEN y1 WHEN 1 THEN x1 WHEN 2 THEN -y1 ELSE -x1 END AS y2, CASE turns WHEN 0 THEN x1 WHEN 1 THEN -y1 WHEN 2 THEN -x1 ELSE y1 END AS x2 FROM t),
a AS (SELECT *, CASE WHEN vflip THEN -y2 ELSE y2 END + 35e-1 AS r, CASE WHEN hflip THEN -x2 ELSE x2 END + 35e-1 AS c FROM q),
b AS (SELECT a.vec_id, a.ty, a.tx, sum((1 - abs(a.r - floor(a.r) - i.d)) * (1 - abs(a.c - floor(a.c) - j.d)) * p.v) AS v, any_value(CASE WHEN toned THEN gain ELSE 1 END) AS gain, any_value(CASE WHEN toned THEN lift ELSE 0 END) AS lift
 FROM a, (VALUES (0), (1)) i(d), (VALUES (0), (1)) j(d), p WHERE {_TAKEN} GROUP BY ALL)
SELECT vec_id, CAST(ty * 8 + tx AS INT) AS pos, round(v * gain + lift, 5) + 0e0 AS value FROM b""")
def augment_patches(spark, sf_dir):
    """The vectors as patches of 8 x 8 with the places above 0 as their mask; values after one augmentation."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array("embedding").alias("bands"), F.transform("embedding", lambda v: (v > 0).cast("int")).alias("mask"))
    a = augment.augment(e, 8, "vec_id")
    return a.select("vec_id", F.posexplode(F.col("bands")[0]).alias("pos", "value")).withColumn("value", F.round("value", 5) + 0.0)  # no negative zero


# Channels of the stages of the encoders that a configuration may name.
ENCODERS = {"resnet18": (64, 64, 128, 256, 512), "resnet34": (64, 64, 128, 256, 512), "resnet50": (64, 256, 512, 1024, 2048), "resnet101": (64, 256, 512, 1024, 2048)}


@query("config_scan", f"""WITH c AS (SELECT concat('exp_', p_partkey) AS name, p_size / 1e3 AS lr, CASE WHEN p_partkey % 3 = 0 THEN p_size / 10e0 END AS factor, CASE WHEN p_partkey % 2 = 0 THEN 'cosine' ELSE 'plateau' END AS scheduler, ['resnet18', 'resnet34', 'resnet50', 'resnet101', 'none'][1 + p_size % 5] AS encoder FROM part),
x AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v[-1]})" for k, v in ENCODERS.items())}) t(encoder, channels))
SELECT name, lr AS learning_rate, coalesce(factor, 1e-1) AS factor, scheduler, encoder, channels FROM c LEFT JOIN x USING (encoder)""")
def config_scan(spark, sf_dir):
    """Every part is an experiment in a JSON array on disk; keys that may be absent get defaults, encoders their last stage's channels."""
    p, path = table(spark, sf_dir, "part"), scratch(spark)
    names = F.array(*[F.lit(n) for n in (*ENCODERS, "none")])
    one = F.struct(F.concat(F.lit("exp_"), "p_partkey").alias("name"), (F.col("p_size") / 1000).alias("learning_rate"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 10).alias("factor"), F.when(F.col("p_partkey") % 2 == 0, "cosine").otherwise("plateau").alias("scheduler"), names[F.col("p_size") % 5].alias("encoder"))
    p.select(F.to_json(one).alias("value")).write.text(path)  # absent keys are not written
    c = training.read_configs(spark, path)
    return c.join(F.broadcast(training.encoders(spark, ENCODERS)), "encoder", "left").select("name", "learning_rate", "factor", "scheduler", "encoder", "channels")


@query("config_limit", "SELECT concat('exp_', p_partkey) AS name, p_retailprice AS metric FROM part ORDER BY p_retailprice DESC, name LIMIT 5")
def config_limit(spark, sf_dir):
    """The first five experiments of a ranking."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("exp_"), "p_partkey").alias("name"), F.col("p_retailprice").alias("metric"))
    return p.orderBy(F.desc("metric"), "name").limit(5)


@query("splits_recombined", "SELECT vec_id AS patch_id, label AS cls FROM embeddings")
def splits_recombined(spark, sf_dir):
    """The three splits of E put together again hold every patch once."""
    from gridloom.operators import split

    d = split.stratified_split(patch_labels(spark, sf_dir).select("patch_id", "cls"), "patch_id")
    return split.recombine([d.filter(F.col("split") == s) for s in ("train", "val", "test")])


@query("frames_concat", "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def frames_concat(spark, sf_dir):
    """Two tables under one another; a column that one lacks is null there."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("learning_rate_schedules", """WITH r AS (SELECT p_brand AS run, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS epoch FROM part)
SELECT run, epoch, round(1e-6 + (1e-3 - 1e-6) * (1 + cos(epoch * pi() / 40)) / 2, 12) AS cosine, round(1e-3 * pow(1e-1, epoch // 10), 12) AS step_lr FROM r WHERE epoch < 40""")
def learning_rate_schedules(spark, sf_dir):
    """The runs' first 40 epochs (parts of a brand) with their rates by two schedules."""
    from gridloom.operators import split

    runs = split.ranked(table(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), "p_partkey"), ["run"], ["p_partkey"])
    epochs = runs.select("run", (F.col("_r") - 1).cast("int").alias("epoch"))
    s = training.schedules(spark, 40, 1e-3).select("epoch", F.round("cosine", 12).alias("cosine"), F.round("step_lr", 12).alias("step_lr"))
    return epochs.join(F.broadcast(s), "epoch").select("run", "epoch", "cosine", "step_lr")


#: Objects: the pixels of class 50 in squares of 20 pixels in the middle of R, moved 3 down and 25 to the right.
_OBJECTS = "o AS (SELECT y // 20 AS object, y + 3 AS y, x + 25 AS x, price AS value, cls FROM r, h WHERE cls = 50 AND y % 20 < 10 AND x BETWEEN 40 AND 59 AND y + 3 < h.h)"


def _pasted(spark, sf_dir, mode):
    r, h = raster(spark, sf_dir), height(spark, sf_dir)
    o = r.filter("cls = 50 AND y % 20 < 10 AND x BETWEEN 40 AND 59").select(F.expr("y div 20").alias("object"), "y", "x", F.col("price").alias("value"), "cls")
    return blend.paste(r.select("y", "x", F.col("price").alias("value"), "cls"), blend.moved(o, 3, 25, h, WIDTH), mode=mode)


@query("paste_feathered", f"""WITH {R}, {_OBJECTS}, g AS (SELECT i AS d, exp(-5e-1 * pow(i / 15e-1, 2)) / (SELECT sum(exp(-5e-1 * pow(k / 15e-1, 2))) FROM range(-5, 6) s(k)) AS w FROM range(-5, 6) t(i)),
a AS (SELECT p.y, p.x, p.value, p.cls, sum(gy.w * gx.w) AS w FROM o p JOIN o q ON q.object = p.object JOIN g gy ON gy.d = q.y - p.y JOIN g gx ON gx.d = q.x - p.x GROUP BY ALL)
SELECT r.y, r.x, round(CASE WHEN a.w IS NULL THEN r.price ELSE a.w * a.value + (1 - a.w) * r.price END, 3) AS value, coalesce(a.cls, r.cls) AS cls FROM r LEFT JOIN a ON a.y = r.y AND a.x = r.x""")
def paste_feathered(spark, sf_dir):
    return _pasted(spark, sf_dir, "feather").withColumn("value", F.round("value", 3))


@query("paste_gradients", None)
def paste_gradients(spark, sf_dir):
    """The same objects with their own gradients; held to a dense solver by test."""
    return _pasted(spark, sf_dir, "poisson")
