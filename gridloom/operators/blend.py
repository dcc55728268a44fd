"""Pasting objects into a raster without a visible rim: feathered by a Gaussian, or with the object's own gradients.

An object is a group of pixels at the place where it is pasted.  Objects are
bounded (``objects`` of :mod:`focal` picks them by area), so each is blended by
itself in one task; what it needs of the raster, its pixels and those beside
them, comes in one join.  Where objects overlap the largest number lies on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.storage import ship

BESIDE = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def moved(pixels: DataFrame, dy, dx, height: int, width: int) -> DataFrame:
    """(object, y, x, value, cls) of object pixels moved by columns or numbers; those that leave the raster are left out."""
    p = pixels.withColumns({"y": (F.col("y") + dy).cast("int"), "x": (F.col("x") + dx).cast("int")})
    return p.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select("object", "y", "x", "value", "cls")


def feather_weights(inside, sigma: float):
    """The share of a Gaussian around each cell that lies on ``inside`` (a boolean array), cut off at three sigma."""
    import numpy as np

    r = max(1, int(np.ceil(3 * sigma)))
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    g /= g.sum()
    a = np.pad(inside.astype(float), r)
    for axis in (0, 1):
        a = np.apply_along_axis(lambda v: np.convolve(v, g, "same"), axis, a)
    return a[r:-r, r:-r]


def solve_gradients(y, x, value, known: dict, tolerance: float = 1e-10):
    """Values at (y, x) whose differences to neighbours in the object are those of ``value``, and 0 to ``known`` ones beside it.

    Least squares over all those differences; conjugate gradients until the
    residual is ``tolerance`` of the right side.  Without any known neighbour the
    object keeps its mean.
    """
    import numpy as np

    at = {p: i for i, p in enumerate(zip(y.tolist(), x.tolist()))}
    n, right, degree = len(value), np.zeros(len(value)), np.zeros(len(value))
    a, b = [], []
    for (py, px), i in at.items():
        for dy, dx in BESIDE:
            q = (py + dy, px + dx)
            if q in at:
                a.append(i)
                b.append(at[q])
                right[i] += value[i] - value[at[q]]
                degree[i] += 1
            elif q in known:
                right[i] += known[q]
                degree[i] += 1
    a, b = np.array(a, int), np.array(b, int)

    def apply(f):
        return degree * f - np.bincount(a, f[b], n) if len(a) else degree * f

    f = value.astype(float).copy()
    alone = degree == 0
    r = np.where(alone, 0.0, right - apply(f))
    p, rr = r.copy(), float(r @ r)
    limit = (tolerance * max(float(np.linalg.norm(right)), 1e-30)) ** 2
    for _ in range(20 * n + 100):
        if rr <= limit:
            break
        q = apply(p)
        step = rr / float(p @ q)
        f, r = f + step * p, r - step * q
        new = float(r @ r)
        p, rr = r + new / rr * p, new
    else:
        raise ArithmeticError("the object's gradients have not been met")
    return f


def paste(raster: DataFrame, objects: DataFrame, *, mode: str = "poisson", sigma: float = 1.5, most: int = 100_000) -> DataFrame:
    """(y, x, value, cls) of ``raster`` with ``objects`` (object, y, x, value, cls) pasted in.

    ``poisson`` keeps an object's inner differences and meets the raster at its
    rim; ``feather`` mixes by the share of a Gaussian of ``sigma`` that lies on the
    object.  The class is the object's.  Null values of either side, and pixels
    that the raster lacks, are not pasted; an object of more than ``most`` pixels
    raises.
    """
    if mode not in ("poisson", "feather"):
        raise ValueError(mode)
    ship(raster.sparkSession)
    o = objects.filter("object is not null and value is not null").groupBy(F.col("object").cast("long").alias("object"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    o = o.agg(F.max(F.struct(F.col("value").cast("double").alias("value"), F.col("cls").cast("int").alias("cls"))).alias("v")).select("object", "y", "x", "v.value", "v.cls")
    near = F.array(F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx")), *[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in BESIDE])
    around = o.select("object", "y", "x", F.explode(near).alias("n")).select("object", (F.col("y") + F.col("n.dy")).alias("y"), (F.col("x") + F.col("n.dx")).alias("x")).distinct()
    ground = raster.filter("value is not null").select("y", "x", F.col("value").cast("double").alias("ground"))
    held = around.join(ground, ["y", "x"]).join(o, ["object", "y", "x"], "left").select("object", "y", "x", "ground", "value", "cls")

    def blend(t):
        import numpy as np
        import pyarrow as pa

        y, x, ground, value = (t.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "ground", "value"))
        mine = ~np.isnan(value)
        if mine.sum() > most:
            raise ValueError(f"an object has more than {most} pixels")
        if mode == "feather":
            y0, x0 = y.min(), x.min()
            inside = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
            inside[y[mine] - y0, x[mine] - x0] = True
            w = feather_weights(inside, sigma)[y[mine] - y0, x[mine] - x0]
            f = w * value[mine] + (1 - w) * ground[mine]
        else:
            known = {(int(a), int(b)): g for a, b, g in zip(y[~mine], x[~mine], ground[~mine])}
            f = solve_gradients(y[mine], x[mine], value[mine], known)
        keep = pa.array(mine)
        return pa.table([t.column("object").filter(keep), t.column("y").filter(keep), t.column("x").filter(keep), pa.array(f), t.column("cls").filter(keep)], names=["object", "y", "x", "new", "label"])

    blended = held.groupBy("object").applyInArrow(blend, "object long, y int, x int, new double, label int")
    top = blended.groupBy("y", "x").agg(F.max(F.struct("object", "new", "label")).alias("t")).select("y", "x", "t.new", "t.label")
    return raster.join(top, ["y", "x"], "left").select("y", "x", F.coalesce("new", "value").alias("value"), F.coalesce("label", "cls").alias("cls"))
