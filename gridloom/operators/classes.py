"""Class inventories, dense re-mapping and class pairings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.expr import pct_text


def histogram(df: DataFrame, col: str = "cls") -> DataFrame:
    """(cls, n, pct, pct_text).  Shares are taken over the histogram, never over pixels in one task."""
    h = df.groupBy(F.col(col).cast("int").alias("cls")).agg(F.count("*").alias("n"))
    pct = F.col("n") * 100e0 / F.sum("n").over(W.partitionBy(F.lit(0)))
    return h.withColumn("pct", pct).withColumn("pct_text", pct_text(F.col("pct")))


def labelled_histogram(df: DataFrame, mapping: DataFrame, col: str = "cls") -> DataFrame:
    """Histogram with the text 'orig -> idx' where a class is mapped."""
    h = histogram(df, col)
    m = mapping.select(F.col("orig").alias("_o"), "idx")
    j = h.join(F.broadcast(m), F.col("cls") == F.col("_o"), "left")
    text = F.when(F.col("idx").isNotNull(), F.concat_ws(" -> ", F.col("cls").cast("string"), F.col("idx").cast("string")))
    return j.select("cls", "n", "pct", F.coalesce(text, F.col("cls").cast("string")).alias("label"))


def domain(df: DataFrame, col: str = "cls", ignore: int | None = None) -> DataFrame:
    """The distinct classes, without nulls and ``ignore``."""
    d = df.select(F.col(col).cast("int").alias("cls")).filter("cls is not null").distinct()
    return d if ignore is None else d.filter(F.col("cls") != ignore)


def domain_flags(df: DataFrame, col: str = "cls") -> DataFrame:
    """One row: n, lo, hi, consecutive, sparse, need_remap.

    consecutive: neighbours differ by one; sparse: not consecutive, and fewer
    classes than 0..largest holds; re-mapping is needed if they are sparse or
    don't begin with 0.
    """
    d = domain(df, col)
    step = F.lead("cls").over(W.orderBy("cls")) - F.col("cls")
    a = d.withColumn("step", step).agg(
        F.count("*").alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.coalesce(F.max("step"), F.lit(1)).alias("gap")
    )
    consecutive = F.col("gap") == 1
    sparse = ~consecutive & (F.col("n") < F.col("hi") + 1)
    return a.select(
        "n",
        "lo",
        "hi",
        consecutive.alias("consecutive"),
        sparse.alias("sparse"),
        (sparse | (F.col("lo") != 0)).alias("need_remap"),
    )


def dense_mapping(df: DataFrame, col: str = "cls", force_zero: bool = True) -> DataFrame:
    """(orig, idx): rank of each class from 0; class 0 takes part if ``force_zero``."""
    d = domain(df, col)
    if force_zero:
        d = d.union(df.sparkSession.range(1).select(F.lit(0).alias("cls"))).distinct()
    return d.select(F.col("cls").alias("orig"), (F.row_number().over(W.orderBy("cls")) - 1).cast("int").alias("idx"))


def invert(mapping: DataFrame) -> DataFrame:
    """idx -> orig as (orig, idx); of originals that share an index the largest stays."""
    return mapping.groupBy(F.col("idx").alias("orig")).agg(F.max("orig").alias("idx"))


def remap(df: DataFrame, mapping: DataFrame, col: str = "cls", to: str | None = None, default: int = 0, keep: int | None = None) -> DataFrame:
    """Look ``col`` up in (orig, idx); unmapped classes become ``default``, ``keep`` stays itself."""
    to = to or col
    m = mapping.select(F.col("orig").alias("_orig"), F.col("idx").alias("_idx"))
    value = F.coalesce("_idx", F.lit(default))
    if keep is not None:
        value = F.when(F.col(col) == keep, F.lit(keep)).otherwise(value)
    return df.join(F.broadcast(m), F.col(col) == F.col("_orig"), "left").withColumn(to, value.cast("int")).drop("_orig", "_idx")


def clean_index(df: DataFrame, num_classes: int, col: str = "cls", ignore: int = -100) -> DataFrame:
    """Classes outside 0..num_classes-1 become ``ignore``."""
    c = F.col(col)
    return df.withColumn(col, F.when((c < 0) | (c >= num_classes), F.lit(ignore)).otherwise(c).cast("int"))


def inspect(df: DataFrame, num_classes: int, group: str, col: str = "cls") -> DataFrame:
    """Per group: lo, hi, n_distinct, n_invalid, in_range, and the classes to provide for."""
    c = F.col(col)
    bad = F.count_if((c < 0) | (c >= num_classes))
    return df.groupBy(group).agg(
        F.min(c).cast("int").alias("lo"),
        F.max(c).cast("int").alias("hi"),
        F.count_distinct(c).alias("n_distinct"),
        bad.alias("n_invalid"),
        (bad == 0).alias("in_range"),
        F.greatest(F.max(c) + 1, F.count_distinct(c)).cast("int").alias("recommended"),
    )


def validation_summary(df: DataFrame, num_classes: int, group: str, col: str = "cls") -> DataFrame:
    """One row: groups and pixels with invalid classes, and the invalid and valid class sets."""
    c = F.col(col)
    bad = (c < 0) | (c >= num_classes)
    return df.agg(
        F.count_distinct(F.when(bad, F.col(group))).alias("groups_bad"),
        F.count_if(bad).alias("pixels_bad"),
        F.count_distinct(F.when(bad, c)).alias("classes_bad"),
        F.count_distinct(F.when(~bad, c)).alias("classes_good"),
    )


def domain_diff(a: DataFrame, b: DataFrame, a_col: str = "cls", b_col: str = "cls") -> DataFrame:
    """(cls, side): classes that only one side has."""
    x, y = domain(a, a_col), domain(b, b_col)
    return x.exceptAll(y).withColumn("side", F.lit("left")).union(y.exceptAll(x).withColumn("side", F.lit("right")))


def domain_union(a: DataFrame, b: DataFrame, a_col: str = "cls", b_col: str = "cls", nodata: int = 255) -> DataFrame:
    """Classes of either side but ``nodata``."""
    return domain(a, a_col, nodata).union(domain(b, b_col, nodata)).distinct()


def positional_mapping(pred: DataFrame, truth: DataFrame, pred_col: str = "pred", truth_col: str = "cls") -> DataFrame:
    """(pred, cls): i-th predicted class to i-th true class; surplus ones to the last.

    Predicted nodata (255) takes no part.  Where both sides have class 0, it
    maps to itself and the others are paired without it.
    """
    p, t = domain(pred, pred_col, ignore=255), domain(truth, truth_col)
    zero = p.filter("cls = 0").join(t.filter("cls = 0"), "cls")  # at most one row
    p, t = p.join(zero, "cls", "left_anti"), t.join(zero, "cls", "left_anti")
    p = p.select(F.col("cls").alias("pred"), F.row_number().over(W.orderBy("cls")).alias("k"))
    t = t.select("cls", F.row_number().over(W.orderBy("cls")).alias("k"))
    last = t.agg(F.max("cls").alias("last"))
    rest = p.join(t, "k", "left").crossJoin(F.broadcast(last)).select("pred", F.coalesce("cls", "last").alias("cls"))
    return zero.select(F.col("cls").alias("pred"), "cls").union(rest)


def cooccurrence(df: DataFrame, pred_col: str = "pred", truth_col: str = "cls") -> DataFrame:
    """(pred, cls, n) over the rows of ``df``; explode pixels over patches first to count overlap."""
    return df.groupBy(F.col(pred_col).alias("pred"), F.col(truth_col).alias("cls")).agg(F.count("*").alias("n"))


def refined_mapping(co: DataFrame, truth_domain: DataFrame, num_classes: int) -> DataFrame:
    """(pred, cls, how): each predicted class takes its most frequent true class.

    Ties: the smallest.  Predicted classes without pixels are paired in order
    with true classes that nobody took; what is left over maps to 0.
    """
    spark = co.sparkSession
    w = W.partitionBy("pred").orderBy(F.desc("n"), "cls")
    best = co.filter("n > 0").withColumn("r", F.row_number().over(w)).filter("r = 1").select("pred", "cls")
    open_pred = spark.range(num_classes).select(F.col("id").cast("int").alias("pred")).join(best, "pred", "left_anti")
    open_true = truth_domain.join(best.select("cls").distinct(), "cls", "left_anti")
    p = open_pred.withColumn("k", F.row_number().over(W.orderBy("pred")))
    t = open_true.withColumn("k", F.row_number().over(W.orderBy("cls")))
    rest = p.join(t, "k", "left").select("pred", F.coalesce("cls", F.lit(0)).alias("cls"), F.lit("leftover").alias("how"))
    return best.select("pred", "cls", F.lit("majority").alias("how")).unionByName(rest)


def detect(df: DataFrame, col: str = "cls") -> DataFrame:
    """One row: classes (sorted array) and num_classes over the pixels of any number of masks.

    Masks of 0 and 1 alone are binary: one class.  Null pixels (unreadable
    files) are left out.  The array is bounded by the class domain.
    """
    d = domain(df, col).agg(F.sort_array(F.collect_list("cls")).alias("classes"))
    binary = F.col("classes") == F.array(F.lit(0), F.lit(1))
    return d.select("classes", F.when(binary, 1).otherwise(F.size("classes")).alias("num_classes"))


def histogram_by_file(df: DataFrame, file: str, col: str = "cls") -> DataFrame:
    """(cls, n, files): pixels and files of each class over many masks; null pixels are left out."""
    c = df.filter(F.col(col).isNotNull()).groupBy(F.col(file).alias("_f"), F.col(col).cast("int").alias("cls")).agg(F.count("*").alias("n"))
    return c.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


def one_hot(df: DataFrame, num_classes: int, col: str = "cls") -> DataFrame:
    """Adds hot, an array of ``num_classes`` zeros with a one at the class; all zeros outside the range."""
    return df.withColumn("hot", F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda k: (k == F.col(col)).cast("int")))
