"""Queries: losses, training tables, scene listings, mappings, sinks and drivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import classes, drivers, focal, losses, normalize, raster as ops, stats, training
from gridloom.sources import mappings, sinks

from .classes import MAP, rounded
from .fixtures import R, V, WIDTH, event_classes, height, literal, raster, table
from .registry import query

#: Every place of a vector is a class with its value as score; the true class is the label.
SCORES = """s AS (SELECT vec_id AS sample, vec_id % 7 AS image, CAST(unnest(range(0, 64)) AS INT) AS cls, CAST(unnest(embedding) AS DOUBLE) AS score, label AS y_true FROM embeddings WHERE len(embedding) = 64),
mx AS (SELECT *, max(score) OVER (PARTITION BY sample) AS m FROM s),
lp AS (SELECT *, score - m - ln(sum(exp(score - m)) OVER (PARTITION BY sample)) AS lp FROM mx)"""


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 7).alias("image"), F.col("label").alias("y_true"), F.posexplode("embedding").alias("cls", "v"))
    return e.select("sample", "image", "cls", F.col("v").cast("double").alias("score"), "y_true")


def _by_class(spark, name: str, value: str):
    return spark.range(64).select(F.col("id").cast("int").alias("cls"), F.expr(value).alias(name))


@query("focal_loss", f"""WITH {SCORES}, a0 AS (SELECT CAST(i AS INT) AS cls, ((i * i) % 31 + 1) / 10e0 AS a FROM range(0, 64) t(i)),
a1 AS (SELECT cls, least(a, (SELECT min(a) FROM a0) * 10) AS a FROM a0), a AS (SELECT cls, a / (SELECT sum(a) FROM a1) AS a FROM a1)
SELECT round(avg(a.a * power(1 - exp(lp), 2) * -lp), 9) AS focal_loss FROM lp JOIN a ON lp.cls = a.cls WHERE lp.cls = lp.y_true""")
def focal_loss(spark, sf_dir):
    return rounded(losses.focal(_scores(spark, sf_dir), _by_class(spark, "alpha", "((id * id) % 31 + 1) / 10e0")), 9)


@query("ce_dice_loss", f"""WITH {SCORES}, ce AS (SELECT sum(-lp * (1 + cls % 5)) / sum(1 + cls % 5) AS ce FROM lp WHERE cls = y_true),
g AS (SELECT image, cls, sum(CASE WHEN cls = y_true THEN exp(lp) ELSE 0 END) AS i, sum(exp(lp)) + count_if(cls = y_true) AS m FROM lp GROUP BY ALL),
d AS (SELECT 1 - avg(CASE WHEN m > 0 THEN 2 * i / (m + 1e-5) ELSE 1 END) AS dice_loss FROM g)
SELECT round(ce, 6) AS ce, round(dice_loss, 6) AS dice_loss, round(ce * 0.7e0 + dice_loss * 0.3e0, 6) AS loss FROM ce, d""")
def ce_dice_loss(spark, sf_dir):
    return rounded(losses.ce_dice(_scores(spark, sf_dir), _by_class(spark, "weight", "1e0 + id % 5"), "image"))


RUNS = "l AS (SELECT p_brand AS run, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS epoch, (p_partkey * 7919) % 1009 AS metric FROM part)"


def _runs(spark, sf_dir):
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "part")
    epoch = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    return p.select(F.col("p_brand").alias("run"), epoch.alias("epoch"), (F.col("p_partkey") * 7919 % 1009).alias("metric"))


@query("early_stopping", f"""WITH {RUNS}, b AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 max(metric) OVER (PARTITION BY run ORDER BY epoch) AS best FROM l), i AS (SELECT *, before IS NULL OR metric > before AS improved FROM b),
k AS (SELECT *, sum(CAST(improved AS INT)) OVER (PARTITION BY run ORDER BY epoch) AS island FROM i),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, island ORDER BY epoch) - 1 AS INT) AS waited FROM k)
SELECT run, epoch, metric, best, improved, waited, max(CAST(waited >= 10 AS INT)) OVER (PARTITION BY run ORDER BY epoch) = 1 AS stopped FROM w""")
def early_stopping(spark, sf_dir):
    return training.early_stopping(_runs(spark, sf_dir)).select("run", "epoch", "metric", "best", "improved", "waited", "stopped")


@query("best_config", f"WITH {RUNS} SELECT run, max(metric) AS metric FROM l GROUP BY run ORDER BY metric DESC, run LIMIT 1")
def best_config(spark, sf_dir):
    return training.best_run(_runs(spark, sf_dir))


@query("results_table", f"WITH {RUNS} SELECT run, count(*) AS epochs, max(metric) AS best, CAST(arg_max(epoch, metric) AS INT) AS best_epoch FROM (SELECT run, metric, min(epoch) AS epoch, count(*) AS c FROM l GROUP BY ALL) GROUP BY run HAVING count(*) > 0".replace("count(*) AS epochs", "CAST(sum(c) AS BIGINT) AS epochs"))
def results_table(spark, sf_dir):
    return training.results(_runs(spark, sf_dir))


@query("epoch_means", f"WITH {RUNS} SELECT epoch, round(avg(metric), 6) AS metric FROM l GROUP BY epoch")
def epoch_means(spark, sf_dir):
    m = stats.epoch_means(_runs(spark, sf_dir), "metric")
    return rounded(m.select("epoch", F.col(m.columns[1]).cast("double").alias("metric")))


@query("scale_clip", f"""WITH {R}, v AS (SELECT y, x, CASE WHEN x % 2 = 0 THEN cust * 7 ELSE cust % 90 - 20 END AS v FROM r), b AS (SELECT x, max(v) > 100 AS big FROM v GROUP BY x)
SELECT v.y, v.x, round(greatest(0, least(1, CASE WHEN big THEN v / 1e4 ELSE v END)), 9) AS value FROM v JOIN b ON v.x = b.x""")
def scale_clip(spark, sf_dir):
    v = F.when(F.col("x") % 2 == 0, F.col("cust") * 7).otherwise(F.col("cust") % 90 - 20)
    return rounded(normalize.scale_and_clip(raster(spark, sf_dir).select("y", "x", v.alias("value")), "x").select("y", "x", "value"), 9)


@query("sigmoid_mask", f"WITH {R} SELECT y, x, round(1 / (1 + exp(-(cust - 500) / 100)), 9) AS p, 1 / (1 + exp(-(cust - 500) / 100)) > 0.5 AS positive FROM r")
def sigmoid_mask(spark, sf_dir):
    p = normalize.sigmoid((F.col("cust") - 500) / 100)
    return raster(spark, sf_dir).select("y", "x", F.round(p, 9).alias("p"), (p > 0.5).alias("positive"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as int)").alias("k"))


@query("mapping_json", f"""WITH {R}, {MAP} SELECT '{{"class_mapping":{{' || string_agg('"' || orig || '":' || idx, ',' ORDER BY orig) || '}},"reverse_mapping":{{' ||
string_agg('"' || idx || '":' || orig, ',' ORDER BY orig) || '}},"class_values":[' || string_agg(orig, ',' ORDER BY orig) || ']}}' AS json FROM m""")
def mapping_json(spark, sf_dir):
    return mappings.to_json(classes.dense_mapping(raster(spark, sf_dir)))


@query("history_json", f"""WITH {RUNS}, e AS (SELECT epoch, max(metric) AS top, count(*) AS n FROM l GROUP BY epoch)
SELECT '{{"top":[' || string_agg(top, ',' ORDER BY epoch) || '],"n":[' || string_agg(n, ',' ORDER BY epoch) || ']}}' AS json FROM e""")
def history_json(spark, sf_dir):
    e = _runs(spark, sf_dir).groupBy("epoch").agg(F.max("metric").alias("top"), F.count("*").alias("n"))
    return sinks.columns_json(e, "epoch", ["top", "n"])


@query("records_json", f"""WITH {R} SELECT '{{"classes":[' || string_agg('{{"cls":' || cls || ',"n":' || n || '}}', ',' ORDER BY cls) || ']}}' AS json FROM (SELECT cls, count(*) AS n FROM r GROUP BY cls)""")
def records_json(spark, sf_dir):
    return sinks.records_json(classes.histogram(raster(spark, sf_dir)).select("cls", "n"), ["cls"], "classes")


@query("class_config", f"WITH {R}, {MAP} SELECT CAST(count(*) AS INT) AS num_classes, string_agg(idx, ',' ORDER BY idx) AS class_values, -1 AS ignore_index FROM m")
def class_config(spark, sf_dir):
    c = sinks.class_config(classes.dense_mapping(raster(spark, sf_dir)))
    return c.withColumn("class_values", F.array_join(F.transform("class_values", lambda v: v.cast("string")), ","))


@query("class_detect", f"""WITH {R} SELECT string_agg(cls, ',' ORDER BY cls) AS classes, CASE WHEN string_agg(cls, ',' ORDER BY cls) = '0,1' THEN 1 ELSE CAST(count(*) AS INT) END AS num_classes
FROM (SELECT DISTINCT CAST(valid AS INT) AS cls FROM r)""")
def class_detect(spark, sf_dir):
    d = classes.detect(raster(spark, sf_dir).withColumn("cls", F.col("valid").cast("int")))
    return d.withColumn("classes", F.array_join(F.transform("classes", lambda v: v.cast("string")), ","))


@query("class_histogram_files", f"WITH {V} SELECT cls, count(*) AS n, count(DISTINCT patch_id) AS files FROM v GROUP BY cls")
def class_histogram_files(spark, sf_dir):
    return classes.histogram_by_file(event_classes(spark, sf_dir), "patch_id")


@query("one_hot", f"WITH {R} SELECT y, x, CASE WHEN pred BETWEEN 0 AND 4 THEN pred ELSE -1 END AS at, CAST(pred BETWEEN 0 AND 4 AS INT) AS total FROM r")
def one_hot(spark, sf_dir):
    h = classes.one_hot(raster(spark, sf_dir), 5, "pred")
    total = F.aggregate("hot", F.lit(0), lambda a, v: a + v)
    return h.select("y", "x", (F.array_position("hot", 1) - 1).cast("int").alias("at"), total.alias("total"))


@query("upsample_2x", f"""WITH {R}, n AS (SELECT CAST(i // 2 AS INT) AS sy, CAST(i AS INT) AS y FROM h, range(0, 100000) t(i) WHERE i < 2 * h.h)
SELECT n.y, CAST(r.x * 2 + d.d AS INT) AS x, r.cls FROM r JOIN n ON r.y = n.sy, (VALUES (0), (1)) d(d)""")
def upsample_2x(spark, sf_dir):
    h = height(spark, sf_dir)
    return ops.RESAMPLE["nearest"](raster(spark, sf_dir).select("y", "x", "cls"), "cls", h, WIDTH, 2 * h, 2 * WIDTH).select("y", "x", "cls")


@query("sharpen_hpf", f"""WITH {R}, o AS (SELECT unnest([-1, 0, 1]) AS d), n AS (SELECT r.y, r.x,
 greatest(0, least(h.h - 1, r.y + a.d)) AS py, greatest(0, least(99, r.x + b.d)) AS px FROM r, h, o a, o b),
s AS (SELECT n.y, n.x, sum(p.price) AS s FROM n JOIN r p ON p.y = n.py AND p.x = n.px GROUP BY ALL), f AS (SELECT r.y, r.x, r.cust, (10 * r.price - s.s) / 9 AS h FROM r JOIN s ON r.y = s.y AND r.x = s.x),
m AS (SELECT avg(h) AS m, min(cust) AS lo, max(cust) AS hi FROM f) SELECT y, x, round(greatest(lo, least(hi, cust + 7e-1 * (h - m))), 4) AS sharp FROM f, m""")
def sharpen_hpf(spark, sf_dir):
    r = raster(spark, sf_dir).filter("y is not null")
    high = focal.high_pass(r.select("y", "x", F.col("price").alias("value")), height(spark, sf_dir), WIDTH).withColumnRenamed("value", "high")
    j = r.select("y", "x", "cust").join(high, ["y", "x"])
    return rounded(ops.SHARPEN["hpf"](j, "cust", F.col("high")).select("y", "x", "sharp"), 4)


SCORED = f"""{R}, p AS (SELECT y, x, CASE WHEN valid THEN pred ELSE 255 END AS p, CASE WHEN pixel_id % 7 = 0 THEN 0 ELSE cls END AS t FROM r),
dp AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM (SELECT DISTINCT p FROM p WHERE p NOT IN (0, 255))), dt AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM p WHERE t <> 0)),
m AS (SELECT 0 AS p, 0 AS c UNION ALL SELECT dp.p, coalesce(dt.t, (SELECT max(t) FROM dt)) FROM dp LEFT JOIN dt ON dp.k = dt.k),
q AS (SELECT coalesce(m.c, 0) AS pred, p.t AS cls FROM p LEFT JOIN m ON p.p = m.p WHERE p.p <> 255 AND p.t <> 0),
lab AS (SELECT cls FROM q UNION SELECT pred FROM q),
k AS (SELECT l.cls, count_if(q.cls = l.cls AND q.pred = l.cls) AS tp, count_if(q.cls <> l.cls AND q.pred = l.cls) AS fp, count_if(q.cls = l.cls AND q.pred <> l.cls) AS fn FROM lab l, q GROUP BY l.cls)"""


@query("score_prediction", f"""WITH {SCORED} SELECT cls, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1, round(coalesce(tp / nullif(CAST(tp + fp + fn AS DOUBLE), 0), 0), 6) AS iou, CAST(tp + fn AS BIGINT) AS support FROM k""")
def score_prediction(spark, sf_dir):
    r = raster(spark, sf_dir)
    pred = r.select("y", "x", F.when(F.col("valid"), F.col("pred")).otherwise(255).alias("pred"))
    truth = r.select("y", "x", F.when(F.col("pixel_id") % 7 == 0, 0).otherwise(F.col("cls")).alias("cls"))
    return rounded(drivers.score(pred, truth)[0])


@query("remap_masks", f"WITH {V}, m AS (SELECT cls AS orig, CAST(row_number() OVER (ORDER BY cls) - 1 AS INT) AS idx FROM (SELECT cls FROM vc UNION SELECT 0)) SELECT patch_id, m.idx AS cls, count(*) AS n FROM v JOIN m ON v.cls = m.orig GROUP BY ALL")
def remap_masks(spark, sf_dir):
    masks, _ = drivers.remap_masks(event_classes(spark, sf_dir))
    return masks.groupBy("patch_id", "cls").agg(F.count("*").alias("n"))


@query("dataset_build", f"""WITH {R}, mp AS (SELECT cls AS orig, CAST(row_number() OVER (ORDER BY cls) - 1 AS INT) AS idx FROM (SELECT DISTINCT cls FROM r UNION SELECT 0)),
g AS (SELECT a.y0, b.x0 FROM (SELECT DISTINCT CAST(least(i * 24, greatest(h.h - 32, 0)) AS INT) AS y0 FROM h, range(0, 100000) t(i) WHERE i <= greatest(ceil((h.h - 32) / 24e0), 0)) a, (SELECT DISTINCT CAST(least(i * 24, 68) AS INT) AS x0 FROM range(0, 4) t(i)) b),
w AS (SELECT y, x, row_number() OVER (PARTITION BY cls ORDER BY md5(CAST(pixel_id AS VARCHAR)), pixel_id) AS k FROM r WHERE cls IN (10, 50)),
u AS (SELECT y0, x0 FROM g UNION SELECT CAST(greatest(0, least(y - 16, h.h - 32)) AS INT), CAST(greatest(0, least(x - 16, 68)) AS INT) FROM w, h WHERE k <= 30),
c AS (SELECT y0, x0, mp.idx, count(*) AS n, sum(CAST(bits % 10 <> 0 AND NOT (2 * y >= h.h AND x < 50) AS INT)) AS ok FROM r CROSS JOIN h JOIN mp ON r.cls = mp.orig JOIN u ON r.y >= y0 AND r.y < y0 + 32 AND r.x >= x0 AND r.x < x0 + 32 GROUP BY ALL),
f AS (SELECT y0, x0, sum(ok) / sum(n) AS fraction FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY y0, x0 ORDER BY n DESC, idx) AS rk FROM c),
j AS (SELECT f.y0, f.x0, f.fraction, k.idx AS major FROM f JOIN k ON f.y0 = k.y0 AND f.x0 = k.x0 WHERE k.rk = 1 AND f.fraction >= 7e-1),
o AS (SELECT *, row_number() OVER (PARTITION BY major ORDER BY md5(CAST(y0 * 100 + x0 AS VARCHAR)), y0, x0) AS p, count(*) OVER (PARTITION BY major) AS n FROM j),
t AS (SELECT *, CAST(ceil(round(n * 15e-2, 9)) AS INT) AS test FROM o), v AS (SELECT *, CAST(ceil(round((n - test) * (15e-2 / 85e-2), 9)) AS INT) AS val FROM t)
SELECT y0, x0, round(fraction, 6) AS fraction, major, CASE WHEN p <= test THEN 'test' WHEN p <= test + val THEN 'val' ELSE 'train' END AS split FROM v""")
def dataset_build(spark, sf_dir):
    h = height(spark, sf_dir)
    valid = (F.col("bits") % 10 != 0) & ~((2 * F.col("y") >= h) & (F.col("x") < 50))
    patches, _ = drivers.build_dataset(raster(spark, sf_dir).withColumn("valid", valid), h, WIDTH, 32, 8, rare=[10, 50])
    return rounded(patches)


@query("unpaired_files", f"WITH {V} SELECT DISTINCT patch_id AS name, 'mask' AS side FROM v WHERE patch_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'image' FROM embeddings WHERE vec_id NOT IN (SELECT patch_id FROM v)")
def unpaired_files(spark, sf_dir):
    from gridloom.sources import arrays

    masks = event_classes(spark, sf_dir).select(F.col("patch_id").alias("name")).distinct()
    return arrays.unpaired(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name")), masks)


def drawn(key: str) -> str:
    """The two draws of a key, as ``normalize.even`` makes them."""
    return ", ".join(f"CAST(concat('0x', substr(md5(concat('{k}:', CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296e0 AS u{k}" for k in (1, 2))


@query("jitter_bounds", f"""WITH {R}, d AS (SELECT *, {drawn('pixel_id')} FROM r), j AS (SELECT *, greatest(0e0, pow(price / 6e5, 8e-1 + 4e-1 * u1) * 6e5 * (9e-1 + 2e-1 * u2)) AS value FROM d)
SELECT y, x, round(value, 3) AS value, value BETWEEN pow(price / 6e5, 12e-1) * 6e5 * 9e-1 - 1e-6 AND pow(price / 6e5, 8e-1) * 6e5 * 11e-1 + 1e-6 AS inside FROM j""")
def jitter_bounds(spark, sf_dir):
    """Jittered prices, and whether they lie within the widest jitter."""
    v, top = F.col("price"), F.lit(600_000.0)
    low, high = F.pow(v / top, 1.2) * top * 0.9, F.pow(v / top, 0.8) * top * 1.1
    r = raster(spark, sf_dir).withColumn("value", normalize.jitter(v, F.col("pixel_id"), top))
    return r.select("y", "x", F.round("value", 3).alias("value"), F.col("value").between(low - 1e-6, high + 1e-6).alias("inside"))
