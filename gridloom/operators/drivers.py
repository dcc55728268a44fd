"""Compositions: scoring a prediction, building a patch dataset, re-mapping its masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import classes, focal, metrics, scoring, split, tiles


def paired(pred: DataFrame, truth: DataFrame, pred_col: str = "pred", truth_col: str = "cls") -> DataFrame:
    """(y, x, pred, cls): pixels that both maps hold, whatever their extents."""
    p = pred.select("y", "x", F.col(pred_col).alias("pred"))
    return p.join(truth.select("y", "x", F.col(truth_col).alias("cls")), ["y", "x"])


def score(pred: DataFrame, truth: DataFrame, mapping: DataFrame | None = None, rule: str = "known") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per-class metrics, summary, confusion) of a prediction against a reference map, both (y, x, class).

    ``mapping`` (pred, cls) takes model classes to true ones; without it the
    classes are paired by position.  Unmapped predictions become 0 and nodata
    (255) stays, which ``rule`` then leaves out with unknown truth.
    """
    both = paired(pred, truth)
    m = classes.positional_mapping(both, both) if mapping is None else mapping
    m = m.select(F.col("pred").alias("orig"), F.col("cls").alias("idx"))
    mapped = classes.remap(both, m, "pred", keep=255)
    cm = metrics.confusion(metrics.scored_pixels(mapped, rule))
    return metrics.per_class(cm), metrics.summary(cm), cm


def build_dataset(
    pixels: DataFrame, height: int, width: int, size: int, overlap: int, *, rare: list[int] | None = None, least_valid: float = 0.7
) -> tuple[DataFrame, DataFrame]:
    """(patches, mapping) of a labelled scene (y, x, cls, valid, pixel_id).

    Classes are mapped to 0..n-1; windows of a regular grid with enough valid
    pixels get their majority class, and windows around pixels of ``rare``
    classes are added.  Splits are stratified by the majority class.  Columns of
    patches: y0, x0, fraction, major, split.
    """
    mapping = classes.dense_mapping(pixels)
    windows = tiles.grid_clamp(pixels.sparkSession, height, width, size, overlap)
    if rare:
        windows = tiles.add_patches(windows.select("y0", "x0"), tiles.rare_windows(pixels, rare, height, width, size))
    held = in_windows(classes.remap(pixels, mapping), windows.select("y0", "x0"), size)
    fraction = tiles.keep_valid(tiles.valid_fraction(held, ["y0", "x0"]), least_valid)
    major = tiles.majority(held, ["y0", "x0"]).select("y0", "x0", "major")
    patches = fraction.join(major, ["y0", "x0"]).withColumn("key", F.col("y0") * width + F.col("x0"))
    parts = split.stratified_split(patches, "key", "major")
    return parts.select("y0", "x0", "fraction", "major", "split"), mapping


def in_windows(pixels: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Each pixel once for every window (y0, x0) that holds it.

    Windows and pixels meet by blocks of the window's size (a window touches at
    most four), an equi-join, and not by their ranges.
    """
    at = lambda c, d: F.floor((F.col(c) + d) / size).cast("int")
    blocks = F.array_distinct(F.array(*[F.struct(at("y0", dy).alias("by"), at("x0", dx).alias("bx")) for dy in (0, size - 1) for dx in (0, size - 1)]))
    w = windows.withColumn("b", F.explode(blocks)).select("y0", "x0", "b.by", "b.bx")
    p = pixels.withColumns({"by": at("y", 0), "bx": at("x", 0)})
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + size) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + size)
    return p.join(w, ["by", "bx"]).filter(inside).drop("by", "bx")


def remap_masks(masks: DataFrame, mapping: DataFrame | None = None, col: str = "cls") -> tuple[DataFrame, DataFrame]:
    """(masks with classes 0..n-1, mapping); without a mapping one is made from the classes that occur."""
    m = classes.dense_mapping(masks, col) if mapping is None else mapping
    return classes.remap(masks, m, col), m


def predict_map(
    stacked: DataFrame, scorer, height: int, width: int, size: int, overlap: int, *, features: str = "features",
    mapping: DataFrame | None = None, least: int | None = None, valid: DataFrame | None = None, nodata: int = 255,
) -> DataFrame:
    """(y, x, cls): the class map of a stacked scene (y, x, features).

    Patches are scored and merged; ``mapping`` (orig, idx) takes model classes back
    to the original ones; with ``least`` the map is then smoothed, parts of fewer
    pixels removed and the gaps filled (:func:`focal.post_process`); pixels that ``valid`` (y, x, valid) marks
    as invalid become ``nodata``.
    """
    m = scoring.predict(stacked, scorer, height, width, size, overlap, features).select("y", "x", "cls")
    if mapping is not None:
        back = mapping.select(F.col("idx").alias("orig"), F.col("orig").alias("idx"))
        m = classes.remap(m, back, keep=nodata)
    if least is not None:
        m = focal.post_process(m, height, width, least=least)
    if valid is not None:
        bad = valid.filter(~F.col("valid")).select("y", "x", F.lit(nodata).alias("_bad"))
        m = m.join(bad, ["y", "x"], "left").select("y", "x", F.coalesce("_bad", "cls").cast("int").alias("cls"))
    return m
