"""Coverage by polygons against a plain clip, boxes, and awkward rings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import geometry

RING = f"ring {geometry.RING}"


def frame(spark, rings):
    return spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in r] if r is not None else None,) for r in rings], RING)


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def clipped(ring, by):
    """``ring`` clipped by a convex ring in positive turn, side by side."""
    for (ax, ay), (bx, by_) in zip(by, by[1:] + by[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by_ - ay) * (p[0] - ax)
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        ring = out
        if not ring:
            return []
    return ring


def union(rings, target):
    """Area of convex rings inside a convex target, by inclusion and exclusion."""
    total = 0.0
    for k in range(1, 1 << len(rings)):
        part = target
        for i, r in enumerate(rings):
            if k >> i & 1 and part:
                part = clipped(part, r)
        total += area(part) * (-1) ** (bin(k).count("1") + 1) if part else 0.0
    return total


def turned(x, y, w, h, a):
    return [(x + math.cos(a) * w * i / 2 - math.sin(a) * h * j / 2, y + math.sin(a) * w * i / 2 + math.cos(a) * h * j / 2) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


@pytest.mark.parametrize("per_cell", [1, 3, 40])
def test_turned_boxes_against_a_clip(spark, per_cell):
    rng = np.random.default_rng(7)
    rings = [turned(*rng.uniform(0, 10, 2), *rng.uniform(1, 5, 2), rng.uniform(0, 3)) for _ in range(8)]
    target = turned(5, 5, 7, 6, 0.4)
    got = geometry.polygon_coverage(frame(spark, rings), target, per_cell).first()
    assert got["area"] == pytest.approx(42) and got["covered"] == pytest.approx(union(rings, target), rel=1e-9)
    assert got["missing"] == pytest.approx(42 - got["covered"]) and got["share"] == pytest.approx(got["covered"] / 0.42)


def test_boxes_are_polygons(spark):
    boxes = spark.createDataFrame([(-5.0, -5.0, 6.0, 8.0), (4.0, 2.0, 8.0, 12.0), (4.0, 2.0, 8.0, 12.0)], "left double, bottom double, right double, top double")
    a = geometry.coverage(boxes, (0, 0, 10, 10)).first()
    b = geometry.polygon_coverage(boxes.select(geometry.box_ring(*[F.col(c) for c in ("left", "bottom", "right", "top")]).alias("ring")), [(0, 0), (10, 0), (10, 10), (0, 10)]).first()
    assert tuple(a) == pytest.approx(tuple(b))


def test_awkward_rings(spark):
    """Null, short and empty rings, others far away, a ring that isn't convex, one in negative turn; no polygons; a target without area."""
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    target = [(0, 0), (4, 0), (4, 4), (0, 4)]
    got = geometry.polygon_coverage(frame(spark, [ell, ell[::-1], None, [], [(0, 0), (9, 9)], [(50, 50), (60, 50), (55, 60)]]), target).first()
    assert tuple(got) == pytest.approx((16, 7, 9, 700 / 16))
    assert tuple(geometry.polygon_coverage(frame(spark, [ell]).limit(0), target).first()) == (16, 0, 16, 0)
    assert geometry.polygon_coverage(frame(spark, [ell]), [(0, 0), (4, 0), (2, 0)]).first()["share"] is None
