"""Queries: band statistics, normalisation, class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import merge, normalize, scoring, stats, weights

from .classes import rounded
from .fixtures import E, L, R, V, event_classes, patch_labels, patch_values, raster, table
from .registry import query

LONG = "lb AS (SELECT y, x, 'cust' AS band, CASE WHEN valid THEN cust ELSE 0 END AS value FROM r UNION ALL SELECT y, x, 'price', price FROM r)"


def _long(spark, sf_dir):
    r = raster(spark, sf_dir).withColumn("cust", F.when(F.col("valid"), F.col("cust")).otherwise(0e0))
    return stats.long_bands(r, {"cust": "cust", "price": "price"})


STAT = "round(min({0}), 6) AS lo, round(max({0}), 6) AS hi, round(avg({0}), 4) AS mean, round(stddev_pop({0}), 4) AS std"


def _stat(df):
    return df.select("band", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("band_stats_positive", f"WITH {R}, {LONG} SELECT band, {STAT.format('value')} FROM lb WHERE value > 0 GROUP BY band")
def band_stats_positive(spark, sf_dir):
    return _stat(stats.positive_stats(_long(spark, sf_dir)))


@query("band_stats_nan", f"WITH {R}, {LONG} SELECT band, {STAT.format('value')} FROM lb WHERE NOT (band = 'cust' AND value = 0) GROUP BY band")
def band_stats_nan(spark, sf_dir):
    nan = F.when((F.col("band") == "cust") & (F.col("value") == 0), F.lit(float("nan"))).otherwise(F.col("value"))
    return _stat(stats.nan_free_stats(_long(spark, sf_dir).withColumn("value", nan)))


@query("band_stats_sampled", f"WITH {R}, s AS (SELECT * FROM r ORDER BY md5(CAST(pixel_id AS VARCHAR)), pixel_id LIMIT 2000) SELECT 'price' AS band, {STAT.format('price')} FROM s WHERE price > 0")
def band_stats_sampled(spark, sf_dir):
    s = stats.sample_positions(raster(spark, sf_dir), "pixel_id", 2000)
    return _stat(stats.positive_stats(stats.long_bands(s, {"price": "price"})))


PCT = f"{R}, {LONG}, p AS (SELECT band, quantile_cont(value, 2e-2) AS p_low, quantile_cont(value, 98e-2) AS p_high FROM lb GROUP BY band)"


@query("band_percentiles", f"WITH {PCT} SELECT band, round(p_low, 6) AS p_low, round(p_high, 6) AS p_high FROM p")
def band_percentiles(spark, sf_dir):
    return rounded(stats.percentiles(_long(spark, sf_dir)))


@query("stretch_2_98", f"WITH {PCT} SELECT y, x, band, round(greatest(0e0, least(1e0, (value - p_low) / (p_high - p_low))), 6) AS value FROM lb JOIN p USING (band)")
def stretch_2_98(spark, sf_dir):
    long = _long(spark, sf_dir)
    return rounded(stats.stretch(long, stats.percentiles(long)).select("y", "x", "band", "value"))


@query("norm_minmax", f"""WITH {E}, p AS (SELECT band, pos, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1, 2), f AS (SELECT band, min(lo) AS lo, max(hi) AS hi FROM p GROUP BY 1)
SELECT image, pos, round((value - lo) / (hi - lo), 6) AS value FROM e JOIN f USING (band)""")
def norm_minmax(spark, sf_dir):
    v = patch_values(spark, sf_dir)
    return rounded(normalize.apply_min_max(v, normalize.fit_min_max(v)).select("image", "pos", "value"))


@query("norm_standard", f"""WITH {E}, p AS (SELECT band, pos, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY 1, 2), f AS (SELECT band, avg(m) AS m, avg(s) AS s FROM p GROUP BY 1)
SELECT image, pos, round((value - m) / greatest(s, 1e-6), 5) AS value FROM e JOIN f USING (band)""")
def norm_standard(spark, sf_dir):
    v = patch_values(spark, sf_dir)
    return rounded(normalize.apply_standard(v, normalize.fit_standard(v)).select("image", "pos", "value"), 5)


@query("norm_pretrained", """SELECT vec_id AS image, pos, round(CASE pos WHEN 0 THEN (v - 485e-3) / 229e-3 WHEN 1 THEN (v - 456e-3) / 224e-3 WHEN 2 THEN (v - 406e-3) / 225e-3 ELSE (v - 5e-1) / 5e-1 END, 5) AS value
FROM (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""")
def norm_pretrained(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode(normalize.pretrained(F.col("embedding"))).alias("pos", "value"))
    return rounded(e, 5)


@query("norm_fallback", f"""WITH {E}, s AS (SELECT image, min(value) AS lo, max(value) AS hi FROM e GROUP BY image)
SELECT image, pos, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END, 5) AS value FROM e JOIN s USING (image)""")
def norm_fallback(spark, sf_dir):
    return rounded(normalize.min_max_by_image(patch_values(spark, sf_dir), "image").select("image", "pos", "value"), 5)


@query("norm_nonzero", f"""WITH {R}, {LONG}, s AS (SELECT band, avg(value) AS m, stddev_pop(value) AS d FROM lb WHERE value > 0 GROUP BY band)
SELECT y, x, band, round((value - m) / greatest(d, 1e-6), 5) AS value FROM lb JOIN s USING (band)""")
def norm_nonzero(spark, sf_dir):
    long = _long(spark, sf_dir)
    return rounded(normalize.apply_standard(long, stats.positive_stats(long).select("band", "mean", "std")).select("y", "x", "band", "value"), 5)


@query("reflectance_scale", f"WITH {R}, s AS (SELECT y, max(cust) > 100 AS big FROM r GROUP BY y) SELECT r.y, r.x, round(CASE WHEN big THEN cust / 1e4 ELSE cust END, 6) AS value FROM r JOIN s USING (y)")
def reflectance_scale(spark, sf_dir):
    r = raster(spark, sf_dir).select("y", "x", F.col("cust").alias("value"))
    return rounded(normalize.scale_reflectance(r, "y"))


@query("clean_non_finite", f"WITH {R} SELECT y, x, CASE WHEN pred = 0 OR pred = 1 OR pred = 2 THEN 0e0 ELSE price END AS value FROM r")
def clean_non_finite(spark, sf_dir):
    bad = F.when(F.col("pred") == 0, F.lit(float("nan"))).when(F.col("pred") == 1, F.lit(float("inf"))).when(F.col("pred") == 2, F.lit(None).cast("double"))
    r = raster(spark, sf_dir).select("y", "x", F.when(F.col("pred") > 2, F.col("price")).otherwise(bad).alias("value"))
    return normalize.clean_values(r)


CENT = """x AS (SELECT vec_id, label, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c AS (SELECT label AS cls, pos, round(avg(v), 6) AS m FROM x GROUP BY 1, 2), sc AS (SELECT vec_id, cls, -sum((v - m) * (v - m)) AS score FROM x JOIN c USING (pos) GROUP BY 1, 2)"""


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return scoring.centroid_scores(e, scoring.centroids(e, "embedding", "label"), "vec_id", "embedding")


@query("softmax", f"WITH {CENT}, w AS (SELECT vec_id, cls, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM sc) SELECT vec_id, cls, round(e / sum(e) OVER (PARTITION BY vec_id), 5) AS p FROM w")
def softmax(spark, sf_dir):
    return rounded(normalize.softmax(_scores(spark, sf_dir), "vec_id").select("vec_id", "cls", "p"), 5)


@query("argmax_class", f"WITH {CENT} SELECT vec_id, cls FROM (SELECT vec_id, cls, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, cls) AS k FROM sc) WHERE k = 1")
def argmax_class(spark, sf_dir):
    return merge.argmax(_scores(spark, sf_dir).withColumnRenamed("score", "p"), ("vec_id",)).select("vec_id", "cls")


@query("scorer_plugin", None)
def scorer_plugin(spark, sf_dir):
    """Probabilities of a pluggable scorer in Arrow batches, with centroids of the axes."""
    scorer = scoring.NearestCentroid([[float(i == k) for i in range(64)] for k in range(4)])
    p = scoring.apply(table(spark, sf_dir, "embeddings"), scorer, "vec_id", "embedding")
    return p.select("vec_id", F.posexplode("probs").alias("cls", "p"))


FILL = f"{V}, f AS (SELECT CAST(i AS INT) AS cls, coalesce(n, 0) AS n FROM range(0, (SELECT max(cls) + 1 FROM vc)) t(i) LEFT JOIN vc ON vc.cls = i)"


def _counts(spark, sf_dir):
    return event_classes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"))


@query("class_weights_sqrt_inv", f"""WITH {FILL}, a AS (SELECT cls, count(*) OVER () AS k, sqrt(sum(n) OVER () / CAST(count(*) OVER () * greatest(n, 1) AS DOUBLE)) AS w FROM f),
b AS (SELECT cls, k, least(w, min(w) OVER () * 10) AS w FROM a) SELECT cls, round(w * k / sum(w) OVER (), 6) AS weight FROM b""")
def class_weights_sqrt_inv(spark, sf_dir):
    return rounded(weights.sqrt_inverse(_counts(spark, sf_dir)))


@query("class_alpha_balanced", f"""WITH {V}, a AS (SELECT cls, 1 / sqrt(CAST(greatest(n, 1) AS DOUBLE)) AS a FROM vc), b AS (SELECT cls, least(a / sum(a) OVER (), 3e-1) AS a FROM a)
SELECT cls, round(a / sum(a) OVER (), 6) AS alpha FROM b""")
def class_alpha_balanced(spark, sf_dir):
    return rounded(weights.balanced_alpha(_counts(spark, sf_dir)))


SF = f"""{V}, q AS (SELECT cls, n, -log10(n / CAST(sum(n) OVER () AS DOUBLE)) AS r FROM vc),
sf AS (SELECT cls, n, CAST(ceil(1e0 + 4e0 * round((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 9)) AS INT) AS factor FROM q)"""


@query("sampling_factors", f"WITH {SF} SELECT cls, n, factor FROM sf")
def sampling_factors(spark, sf_dir):
    return weights.sampling_factors(_counts(spark, sf_dir))


@query("oversample_multiset", f"""WITH {SF}, u AS (SELECT DISTINCT patch_id, cls FROM v) SELECT patch_id, CAST(1 + sum(factor - 1) AS BIGINT) AS copies FROM u JOIN sf USING (cls) GROUP BY patch_id""")
def oversample_multiset(spark, sf_dir):
    return weights.oversample(event_classes(spark, sf_dir), weights.sampling_factors(_counts(spark, sf_dir)))


@query("patch_class_counts", f"WITH {L} SELECT rare_cls AS cls, count(*) AS n FROM l GROUP BY 1")
def patch_class_counts(spark, sf_dir):
    return patch_labels(spark, sf_dir).groupBy(F.col("rare_cls").alias("cls")).agg(F.count("*").alias("n"))
