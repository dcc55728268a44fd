"""Pasted objects against a dense solver and a plain Gaussian, with overlaps, rims and holes."""

import math

import numpy as np
import pytest

from gridloom.operators import blend


def ground(h, w):
    return {(y, x): math.sin(y / 3) * 10 + x for y in range(h) for x in range(w)}


def blob(seed, h, w, share=0.8):
    rng = np.random.default_rng(seed)
    return {(y, x): float(rng.normal(100, 5)) for y in range(h) for x in range(w) if rng.random() < share}


def run(spark, base, objects, **more):
    r = spark.createDataFrame([(y, x, v, 0) for (y, x), v in base.items()], "y int, x int, value double, cls int").repartition(3)
    o = spark.createDataFrame([(k, y, x, v, k + 10) for k, o in objects.items() for (y, x), v in o.items()], "object long, y int, x int, value double, cls int")
    got = blend.paste(r, o, **more).collect()
    assert len(got) == len(base)
    return {(r["y"], r["x"]): r["value"] for r in got}, {(r["y"], r["x"]): r["cls"] for r in got}


def dense(base, o):
    """The normal equations of one object as a matrix."""
    at = {p: i for i, p in enumerate(p for p in o if base.get(p) is not None)}
    a, b = np.zeros((len(at), len(at))), np.zeros(len(at))
    for p, i in at.items():
        for dy, dx in blend.BESIDE:
            q = (p[0] + dy, p[1] + dx)
            if q in at:
                a[i, i] += 1
                a[i, at[q]] -= 1
                b[i] += o[p] - o[q]
            elif base.get(q) is not None:
                a[i, i] += 1
                b[i] += base[q]
    return dict(zip(at, np.linalg.solve(a, b)))


def test_gradients_against_a_dense_solver(spark):
    """One object at the raster's side, one with holes inside, one over another: the larger number lies on top."""
    base = ground(24, 20)
    base[12, 12] = None
    shift = lambda o, dy, dx: {(y + dy, x + dx): v for (y, x), v in o.items()}
    objects = {1: shift(blob(1, 8, 9), 0, 0), 2: shift(blob(2, 9, 9), 9, 8), 3: shift(blob(3, 5, 5, 1.1), 12, 10)}
    value, cls = run(spark, base, objects)
    want, label = dict(base), dict.fromkeys(base, 0)
    for k in (1, 2, 3):
        for p, v in dense(base, objects[k]).items():
            want[p], label[p] = v, k + 10
    assert cls == label and all((value[p] is None) == (want[p] is None) and (want[p] is None or abs(value[p] - want[p]) < 1e-6) for p in want)


def test_a_constant_object_vanishes_and_a_lone_one_stays(spark):
    """Without gradients an object takes its ground's; one that covers all of the raster keeps its values."""
    base = {(y, x): 7.0 for y in range(9) for x in range(9)}
    value, _ = run(spark, base, {1: {(y, x): 50.0 for y in range(3, 6) for x in range(3, 6)}})
    assert all(abs(v - 7) < 1e-8 for v in value.values())
    whole = {p: float(p[0] * p[1]) for p in base}
    assert run(spark, base, {1: whole})[0] == whole


def test_feather_against_a_plain_gaussian(spark):
    base, o = ground(15, 15), {(y + 4, x + 3): v for (y, x), v in blob(5, 6, 7).items()}
    sigma, r = 1.2, 4
    g = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    g = [v / sum(g) for v in g]
    value, _ = run(spark, base, {1: o}, mode="feather", sigma=sigma)
    for p, v in base.items():
        w = sum(g[i + r] * g[j + r] for i in range(-r, r + 1) for j in range(-r, r + 1) if (p[0] + i, p[1] + j) in o) if p in o else 0
        assert value[p] == pytest.approx(w * o.get(p, 0) + (1 - w) * v)


def test_bounds_and_nothing(spark):
    base = ground(4, 4)
    assert run(spark, base, {})[0] == base
    with pytest.raises(Exception):
        run(spark, base, {1: base}, most=3)
    with pytest.raises(ValueError):
        run(spark, base, {}, mode="other")
    o = spark.createDataFrame([(1, 0, 0, 1.0, 5), (1, 0, 3, 1.0, 5)], "object long, y int, x int, value double, cls int")
    assert [(r["y"], r["x"]) for r in blend.moved(o, 1, 2, 4, 4).collect()] == [(1, 2)]
