"""Queries: class inventories, mappings and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import classes, metrics, tiles

from .fixtures import R, WIDTH, height, raster, table
from .registry import query

MAP = """d AS (SELECT DISTINCT cls FROM r UNION SELECT 0), m AS (SELECT cls AS orig, CAST(row_number() OVER (ORDER BY cls) - 1 AS INT) AS idx FROM d)"""


@query("class_histogram", f"WITH {R} SELECT cls, n, round(n * 100e0 / sum(n) OVER (), 6) AS pct, printf('%.2f%%', n * 100e0 / sum(n) OVER ()) AS pct_text FROM (SELECT cls, count(*) AS n FROM r GROUP BY cls)")
def class_histogram(spark, sf_dir):
    return classes.histogram(raster(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


@query("class_histogram_labelled", f"WITH {R}, {MAP} SELECT r.cls, count(*) AS n, CAST(r.cls AS VARCHAR) || ' -> ' || CAST(any_value(m.idx) AS VARCHAR) AS label FROM r JOIN m ON r.cls = m.orig GROUP BY r.cls")
def class_histogram_labelled(spark, sf_dir):
    r = raster(spark, sf_dir)
    return classes.labelled_histogram(r, classes.dense_mapping(r)).select("cls", "n", "label")


@query("class_domain_flags", f"""WITH {R}, d AS (SELECT cls, lead(cls) OVER (ORDER BY cls) - cls AS step FROM (SELECT DISTINCT cls FROM r)),
a AS (SELECT count(*) AS n, min(cls) AS lo, max(cls) AS hi, coalesce(max(step), 1) AS gap FROM d)
SELECT n, lo, hi, gap = 1 AS consecutive, gap <> 1 AND n < hi + 1 AS sparse, (gap <> 1 AND n < hi + 1) OR lo <> 0 AS need_remap FROM a""")
def class_domain_flags(spark, sf_dir):
    return classes.domain_flags(raster(spark, sf_dir))


@query("class_mapping_dense", f"WITH {R}, {MAP} SELECT orig, idx FROM m")
def class_mapping_dense(spark, sf_dir):
    return classes.dense_mapping(raster(spark, sf_dir))


@query("class_remap", f"WITH {R}, {MAP} SELECT r.y, r.x, coalesce(m.idx, 0) AS cls FROM r LEFT JOIN m ON r.cls = m.orig")
def class_remap(spark, sf_dir):
    r = raster(spark, sf_dir)
    return classes.remap(r, classes.dense_mapping(r)).select("y", "x", "cls")


@query("class_remap_inverse", f"WITH {R}, {MAP} SELECT r.y, r.x, coalesce(m.orig, 0) AS cls FROM r LEFT JOIN m ON r.pred = m.idx")
def class_remap_inverse(spark, sf_dir):
    r = raster(spark, sf_dir)
    return classes.remap(r, classes.invert(classes.dense_mapping(r)), "pred", "cls").select("y", "x", "cls")


@query("class_remap_nodata", f"""WITH {R}, {MAP}, p AS (SELECT y, x, CASE WHEN valid THEN pred ELSE 255 END AS p FROM r)
SELECT p.y, p.x, CASE WHEN p.p = 255 THEN 255 ELSE coalesce(m.orig, 0) END AS cls FROM p LEFT JOIN m ON p.p = m.idx""")
def class_remap_nodata(spark, sf_dir):
    r = raster(spark, sf_dir)
    p = r.withColumn("p", F.when(F.col("valid"), F.col("pred")).otherwise(255))
    return classes.remap(p, classes.invert(classes.dense_mapping(r)), "p", "cls", keep=255).select("y", "x", "cls")


@query("mask_clean", f"WITH {R} SELECT y, x, CASE WHEN pred >= 4 THEN -100 ELSE pred END AS pred FROM r")
def mask_clean(spark, sf_dir):
    return classes.clean_index(raster(spark, sf_dir), 4, "pred").select("y", "x", "pred")


@query("mask_inspect", """SELECT user_id % 50 AS g, CAST(min(c) AS INT) AS lo, CAST(max(c) AS INT) AS hi, count(DISTINCT c) AS n_distinct, count_if(c >= 4) AS n_invalid,
count_if(c >= 4) = 0 AS in_range, CAST(greatest(max(c) + 1, count(DISTINCT c)) AS INT) AS recommended
FROM (SELECT user_id, CAST(least(9, floor(value / 50)) AS INT) AS c FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def mask_inspect(spark, sf_dir):
    from .fixtures import event_classes

    return classes.inspect(event_classes(spark, sf_dir).withColumn("g", F.col("patch_id") % 50), 4, "g")


@query("mask_validation", """SELECT count(DISTINCT CASE WHEN c >= 4 THEN user_id END) AS groups_bad, count_if(c >= 4) AS pixels_bad, count(DISTINCT CASE WHEN c >= 4 THEN c END) AS classes_bad,
count(DISTINCT CASE WHEN c < 4 THEN c END) AS classes_good FROM (SELECT user_id, CAST(least(9, floor(value / 50)) AS INT) AS c FROM events WHERE value IS NOT NULL)""")
def mask_validation(spark, sf_dir):
    from .fixtures import event_classes

    return classes.validation_summary(event_classes(spark, sf_dir), 4, "patch_id")


@query("class_domain_diff", f"""WITH {R} SELECT cls, 'left' AS side FROM (SELECT DISTINCT cls FROM r EXCEPT SELECT DISTINCT pred10 FROM r)
UNION ALL SELECT pred10, 'right' FROM (SELECT DISTINCT pred10 FROM r EXCEPT SELECT DISTINCT cls FROM r)""")
def class_domain_diff(spark, sf_dir):
    r = raster(spark, sf_dir)
    return classes.domain_diff(r, r, "cls", "pred10")


@query("class_domain_union", f"WITH {R} SELECT cls FROM (SELECT cls FROM r UNION SELECT pred10 FROM r) WHERE cls <> 255")
def class_domain_union(spark, sf_dir):
    r = raster(spark, sf_dir)
    return classes.domain_union(r, r, "cls", "pred10")


@query("positional_class_map", f"""WITH {R}, s AS (SELECT CASE WHEN valid THEN pred ELSE 255 END AS p, CASE WHEN pixel_id % 7 = 0 THEN 0 ELSE least(cls, 40) END AS t FROM r),
p AS (SELECT p AS pred, row_number() OVER (ORDER BY p) AS k FROM (SELECT DISTINCT p FROM s WHERE p NOT IN (0, 255))),
t AS (SELECT t AS cls, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM s WHERE t <> 0))
SELECT 0 AS pred, 0 AS cls UNION ALL SELECT p.pred, coalesce(t.cls, (SELECT max(cls) FROM t)) FROM p LEFT JOIN t ON p.k = t.k""")
def positional_class_map(spark, sf_dir):
    r = raster(spark, sf_dir)
    truth = F.when(F.col("pixel_id") % 7 == 0, 0).otherwise(F.least("cls", F.lit(40)))
    s = r.select(F.when(F.col("valid"), F.col("pred")).otherwise(255).alias("pred"), truth.alias("cls"))
    return classes.positional_mapping(s, s)


@query("cooccurrence", f"WITH {R} SELECT pred, cls, count(*) AS n FROM r GROUP BY pred, cls")
def cooccurrence(spark, sf_dir):
    return classes.cooccurrence(raster(spark, sf_dir))


GRID = """g AS (SELECT a.y0, b.x0 FROM (SELECT DISTINCT CAST(least(i * 24, greatest(h.h - 32, 0)) AS INT) AS y0 FROM h, range(0, 100000) t(i) WHERE i <= greatest(ceil((h.h - 32) / 24e0), 0)) a,
(SELECT DISTINCT CAST(least(i * 24, 68) AS INT) AS x0 FROM range(0, 4) t(i)) b)"""
IN = "r.y >= g.y0 AND r.y < g.y0 + 32 AND r.x >= g.x0 AND r.x < g.x0 + 32"


@query("cooccurrence_patches", f"WITH {R}, {GRID} SELECT pred, cls, count(*) AS n FROM r JOIN g ON {IN} GROUP BY pred, cls")
def cooccurrence_patches(spark, sf_dir):
    return classes.cooccurrence(tiles.cover(raster(spark, sf_dir), height(spark, sf_dir), WIDTH, 32, 8))


@query("refined_mapping", f"""WITH {R}, c AS (SELECT CASE WHEN pred = 4 THEN 5 ELSE pred END AS pred, cls, count(*) AS n FROM r GROUP BY 1, cls),
b AS (SELECT pred, cls FROM (SELECT pred, cls, row_number() OVER (PARTITION BY pred ORDER BY n DESC, cls) AS k FROM c) WHERE k = 1),
p AS (SELECT pred, row_number() OVER (ORDER BY pred) AS k FROM (SELECT CAST(i AS INT) AS pred FROM range(0, 8) t(i)) WHERE pred NOT IN (SELECT pred FROM b)),
t AS (SELECT cls, row_number() OVER (ORDER BY cls) AS k FROM (SELECT DISTINCT cls FROM r) WHERE cls NOT IN (SELECT cls FROM b))
SELECT pred, cls, 'majority' AS how FROM b UNION ALL SELECT p.pred, coalesce(t.cls, 0), 'leftover' FROM p LEFT JOIN t ON p.k = t.k""")
def refined_mapping(spark, sf_dir):
    """A model that never predicts its class 4, so that this one and the last two are left over."""
    r = raster(spark, sf_dir).withColumn("pred", F.when(F.col("pred") == 4, 5).otherwise(F.col("pred")))
    return classes.refined_mapping(classes.cooccurrence(r), classes.domain(r), 8)


CM = f"""{R}, s AS (SELECT cls, pred10 AS pred FROM r), lab AS (SELECT cls FROM s UNION SELECT pred FROM s),
cm AS (SELECT a.cls AS y_true, b.cls AS y_pred, CAST(count(s.cls) AS BIGINT) AS n FROM lab a CROSS JOIN lab b LEFT JOIN s ON s.cls = a.cls AND s.pred = b.cls GROUP BY 1, 2)"""
PC = f"""{CM}, k AS (SELECT l.cls, sum(CASE WHEN y_true = l.cls AND y_pred = l.cls THEN n ELSE 0 END) AS tp,
 sum(CASE WHEN y_true <> l.cls AND y_pred = l.cls THEN n ELSE 0 END) AS fp, sum(CASE WHEN y_true = l.cls AND y_pred <> l.cls THEN n ELSE 0 END) AS fn FROM lab l, cm GROUP BY l.cls),
pc AS (SELECT cls, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
 coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1, coalesce(tp / nullif(CAST(tp + fp + fn AS DOUBLE), 0), 0) AS iou, CAST(tp + fn AS BIGINT) AS support FROM k)"""


def _cm(spark, sf_dir):
    return metrics.confusion(raster(spark, sf_dir), "cls", "pred10")


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("confusion_matrix", f"WITH {CM} SELECT y_true, y_pred, n FROM cm")
def confusion_matrix(spark, sf_dir):
    return _cm(spark, sf_dir)


@query("confusion_normalized", f"""WITH {CM}, w AS (SELECT *, sum(n) OVER (PARTITION BY y_true) AS s FROM cm)
SELECT y_true, y_pred, n, round(coalesce(n / nullif(CAST(s AS DOUBLE), 0), 0), 6) AS share, round(n / nullif(CAST(s AS DOUBLE), 0), 6) AS share_null, round(n / (s + 1e-8), 6) AS share_eps FROM w""")
def confusion_normalized(spark, sf_dir):
    return rounded(metrics.normalized(_cm(spark, sf_dir)))


@query("metrics_per_class", f"WITH {PC} SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou, support FROM pc")
def metrics_per_class(spark, sf_dir):
    return rounded(metrics.per_class(_cm(spark, sf_dir)))


SUMMARY = """SELECT round(sum(tp) / CAST(sum(tp + fn) AS DOUBLE), 6) AS accuracy, round(sum(tp) / CAST(sum(tp + fp) AS DOUBLE), 6) AS precision_micro, round(sum(tp) / CAST(sum(tp + fn) AS DOUBLE), 6) AS recall_micro,
 round(2 * sum(tp) / CAST(sum(2 * tp + fp + fn) AS DOUBLE), 6) AS f1_micro, {rest} FROM k JOIN pc USING (cls)"""
REST = ", ".join(f"round(avg({n}), 6) AS {n}_macro, round(sum({n} * support) / sum(support), 6) AS {n}_weighted" for n in ("precision", "recall", "f1", "iou"))


@query("metrics_summary", f"WITH {PC} {SUMMARY.format(rest=REST)}")
def metrics_summary(spark, sf_dir):
    return rounded(metrics.summary(_cm(spark, sf_dir)))


@query("metrics_weighted", f"WITH {PC} SELECT round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(sum(iou * support) / sum(support), 6) AS iou_weighted FROM pc")
def metrics_weighted(spark, sf_dir):
    r = metrics.scored_pixels(raster(spark, sf_dir))
    return rounded(metrics.summary(metrics.confusion(r, "cls", "pred10")).select("precision_weighted", "recall_weighted", "f1_weighted", "iou_weighted"))


FIXED = PC.replace("lab AS (SELECT cls FROM s UNION SELECT pred FROM s)", "lab AS (SELECT CAST(i AS INT) * 10 AS cls FROM range(0, 10) t(i))")


@query("metrics_fixed_labels", f"WITH {FIXED} SELECT cls, round(f1, 6) AS f1, round(iou, 6) AS iou, support FROM pc")
def metrics_fixed_labels(spark, sf_dir):
    labels = spark.range(10).select((F.col("id") * 10).cast("int").alias("cls"))
    r = metrics.scored_pixels(raster(spark, sf_dir), "byte")
    return rounded(metrics.per_class(metrics.confusion(r, "cls", "pred10", labels)).select("cls", "f1", "iou", "support"))


@query("metrics_binary", """WITH a AS (SELECT count_if(quality <> 1 AND toxic <> 1) AS tn, count_if(quality <> 1 AND toxic = 1) AS fp, count_if(quality = 1 AND toxic <> 1) AS fn, count_if(quality = 1 AND toxic = 1) AS tp FROM labels)
SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round(tp / CAST(tp + fp + fn AS DOUBLE), 6) AS iou FROM a""")
def metrics_binary(spark, sf_dir):
    return rounded(metrics.binary(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("metrics_melted", f"WITH {PC} SELECT cls, variable, round(value, 6) AS value FROM (UNPIVOT (SELECT cls, precision, recall, f1, iou FROM pc) ON precision, recall, f1, iou INTO NAME variable VALUE value)")
def metrics_melted(spark, sf_dir):
    return rounded(metrics.melted(metrics.per_class(_cm(spark, sf_dir))))


DP = f"""{CM}, dp AS (SELECT y % 4 AS batch, l.cls, count_if(r.cls = l.cls AND pred10 = l.cls) AS tp, count_if(r.cls <> l.cls AND pred10 = l.cls) AS fp, count_if(r.cls = l.cls AND pred10 <> l.cls) AS fn
 FROM r JOIN lab l ON r.cls = l.cls OR r.pred10 = l.cls GROUP BY 1, 2)"""


@query("dice_partial", f"WITH {DP} SELECT batch, cls, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM dp")
def dice_partial(spark, sf_dir):
    return metrics.dice_parts(raster(spark, sf_dir).withColumn("batch", F.col("y") % 4), "batch", "cls", "pred10")


@query("dice_final", f"""WITH {DP}, f AS (SELECT cls, sum(tp) AS tp, sum(fp + fn) AS w FROM dp GROUP BY cls)
SELECT cls, round(coalesce(2 * tp / nullif(CAST(2 * tp + w AS DOUBLE), 0), 0), 6) AS dice, round(coalesce(tp / nullif(CAST(tp + w AS DOUBLE), 0), 0), 6) AS iou, round((2 * tp + 1e-6) / (2 * tp + w + 1e-6), 6) AS dice_eps, round((tp + 1e-6) / (tp + w + 1e-6), 6) AS iou_eps FROM f""")
def dice_final(spark, sf_dir):
    return rounded(metrics.dice(dice_partial(spark, sf_dir)))
