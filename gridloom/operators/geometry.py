"""Coverage of a box by boxes, and of a polygon by polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.storage import ship


def coverage(boxes: DataFrame, target: tuple[float, float, float, float]) -> DataFrame:
    """One row: area, covered, missing, share (percent) of ``target`` (left, bottom, right, top).

    The boxes' edges cut the target into cells; a cell is covered if a box
    holds its middle.  Rows: cells, bounded by the square of twice the boxes.
    """
    l, b, r, t = map(float, target)
    spark = boxes.sparkSession
    xs = boxes.select(F.explode(F.array("left", "right")).alias("v")).union(spark.range(1).select(F.explode(F.array(F.lit(l), F.lit(r))).alias("v")))
    ys = boxes.select(F.explode(F.array("bottom", "top")).alias("v")).union(spark.range(1).select(F.explode(F.array(F.lit(b), F.lit(t))).alias("v")))

    def cells(c: DataFrame, lo: float, hi: float, name: str) -> DataFrame:
        # a box table holds a row a scene, so its edges fit one sorted array
        s = c.select(F.least(F.greatest("v", F.lit(lo)), F.lit(hi)).alias("v")).distinct().agg(F.sort_array(F.collect_list("v")).alias("s"))
        pairs = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        return s.select(F.explode(pairs).alias("c")).select(F.col("c.p").alias(f"{name}0"), F.col("c.q").alias(f"{name}1"))

    grid = cells(xs, l, r, "x").crossJoin(cells(ys, b, t, "y"))
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("left") <= mx) & (mx <= F.col("right")) & (F.col("bottom") <= my) & (my <= F.col("top"))
    hit = grid.join(boxes, inside, "left_semi")
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    whole = (r - l) * (t - b)
    return hit.agg(F.coalesce(area, F.lit(0.0)).alias("covered")).select(
        F.lit(whole).alias("area"), "covered", (F.lit(whole) - F.col("covered")).alias("missing"), (F.col("covered") * 100 / F.lit(whole)).alias("share")
    )


RING = "array<struct<x:double,y:double>>"


def box_ring(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """The ring of a box along the axes."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(left, bottom), at(right, bottom), at(right, top), at(left, top))


def turned_box(x: Column, y: Column, wide: Column, high: Column, angle: Column) -> Column:
    """The ring of a box around (x, y) turned by ``angle`` (radians)."""
    at = lambda a, b: F.struct(
        (x + F.cos(angle) * wide * a / 2 - F.sin(angle) * high * b / 2).cast("double").alias("x"), (y + F.sin(angle) * wide * a / 2 + F.cos(angle) * high * b / 2).cast("double").alias("y")
    )
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def _crossings(rings, y):
    """[(start, end)] where the horizontal line at y is inside any ring (even-odd), merged and in order."""
    spans = []
    for ring in rings:
        xs = []
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 <= y) != (y1 <= y):
                xs.append(x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        xs.sort()
        spans += zip(xs[::2], xs[1::2])
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def area_inside(rings, target, left, bottom, right, top) -> tuple[float, float]:
    """(area of the target, of it covered by any ring) inside a cell, by a sweep over the rows between all corners and crossings.

    Between two neighbouring heights no edge begins, ends or meets another, so
    what a row covers grows linearly and its middle gives its area exactly.
    """
    sides = [[(left, bottom), (left, top)], [(right, bottom), (right, top)]]
    edges = [e for ring in [*rings, target] for e in zip(ring, ring[1:] + ring[:1])] + [tuple(s) for s in sides]
    near = [((x0, y0), (x1, y1)) for (x0, y0), (x1, y1) in edges if max(y0, y1) > bottom and min(y0, y1) < top]
    heights = {bottom, top, *[y for e in near for _, y in e if bottom < y < top]}
    near = [e for e in near if e[0][1] != e[1][1] and max(e[0][0], e[1][0]) >= left and min(e[0][0], e[1][0]) <= right]
    for i, ((ax, ay), (bx, by)) in enumerate(near):
        for (cx, cy), (dx, dy) in near[:i]:
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if turn:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn
                y = ay + t * (by - ay)
                if 0 <= t <= 1 and bottom < y < top:
                    heights.add(y)
    whole = covered = 0.0
    levels = sorted(heights)
    for lo, hi in zip(levels, levels[1:]):
        y = (lo + hi) / 2
        clip = lambda s: [(max(a, left), min(b, right)) for a, b in s if min(b, right) > max(a, left)]
        goal, held = clip(_crossings([target], y)), clip(_crossings(rings, y))
        whole += (hi - lo) * sum(b - a for a, b in goal)
        covered += (hi - lo) * sum(max(0.0, min(b, d) - max(a, c)) for a, b in goal for c, d in held)
    return whole, covered


def polygon_coverage(polygons: DataFrame, target: list[tuple[float, float]], per_cell: int = 40) -> DataFrame:
    """One row: area, covered, missing, share (percent) of the ring ``target`` by the union of ``polygons`` (ring).

    Rings are simple polygons, closed by themselves, of any turn.  They are dealt
    to the cells of a grid over the target that their boxes meet, some ``per_cell``
    to a cell, and every cell is swept by itself.  Equal rings count once, and cells
    are no smaller than the rings' boxes on average, so no ring is in more than a few
    of them for its size.  Null rings and those of fewer
    than three corners cover nothing; a target without area has share null.
    """
    import pyarrow as pa

    spark = polygons.sparkSession
    ship(spark)
    xs, ys = [float(x) for x, _ in target], [float(y) for _, y in target]
    left, right, bottom, top = min(xs), max(xs), min(ys), max(ys)
    p = polygons.select(F.col("ring").cast(RING).alias("ring")).filter(F.size("ring") >= 3).distinct()
    end = lambda f, c: f(F.transform("ring", lambda q: q[c]))
    p = p.select("ring", end(F.array_min, "x").alias("a"), end(F.array_max, "x").alias("b"), end(F.array_min, "y").alias("c"), end(F.array_max, "y").alias("d"))
    p = p.filter((F.col("b") > left) & (F.col("a") < right) & (F.col("d") > bottom) & (F.col("c") < top))
    count, box_x, box_y = p.agg(F.count("*"), F.avg(F.col("b") - F.col("a")), F.avg(F.col("d") - F.col("c"))).first()
    fit = [int(min((far - near) / box, 2**15)) for far, near, box in ((right, left, box_x), (top, bottom, box_y)) if box and box == box]
    n = max(1, min(int((count / per_cell) ** 0.5) + 1, *fit, 2**15))
    wide, high = (right - left) / n or 1.0, (top - bottom) / n or 1.0

    def span(lo, hi, start, step):
        at = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - start) / step).cast("int")))
        return F.explode(F.sequence(at(lo), at(hi)))

    dealt = p.select("ring", "c", "d", span(F.col("a"), F.col("b"), left, wide).alias("i")).select("ring", "i", span(F.col("c"), F.col("d"), bottom, high).alias("j"))
    cells = spark.range(n * n).select((F.col("id") % n).cast("int").alias("i"), F.floor(F.col("id") / n).cast("int").alias("j"), F.lit(None).cast(RING).alias("ring"))
    ring = [(float(x), float(y)) for x, y in target]

    def sweep(key, t):
        i, j = (k.as_py() for k in key)
        rings = [[(q["x"], q["y"]) for q in r] for r in t.column("ring").to_pylist() if r]
        side = lambda k, start, step, last: last if k == n else start + k * step
        whole, covered = area_inside(rings, ring, side(i, left, wide, right), side(j, bottom, high, top), side(i + 1, left, wide, right), side(j + 1, bottom, high, top))
        return pa.table([pa.array([whole]), pa.array([covered])], names=["area", "covered"])

    swept = dealt.unionByName(cells).groupBy("i", "j").applyInArrow(sweep, "area double, covered double")
    total = swept.agg(F.sum("area").alias("area"), F.sum("covered").alias("covered"))
    return total.select("area", "covered", (F.col("area") - F.col("covered")).alias("missing"), (100 * F.col("covered") / F.nullif("area", F.lit(0.0))).alias("share"))
