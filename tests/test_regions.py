"""Components by blocks and gap filling in order, against a search and a sequential loop."""

import numpy as np
import pytest

from gridloom.operators import focal


def frame(spark, cells, cls="cls int"):
    return spark.createDataFrame([(y, x, c) for (y, x), c in cells.items()], f"y int, x int, {cls}").repartition(3)


def flood(cells, diagonal):
    """{cell: smallest pixel number of its component}."""
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    out = {}
    for start in sorted(cells):
        if start in out:
            continue
        out[start], todo = start, [start]
        while todo:
            y, x = todo.pop()
            for dy, dx in near:
                n = (y + dy, x + dx)
                if n not in out and cells.get(n) == cells[start]:
                    out[n] = start
                    todo.append(n)
    return {c: s[0] * 2**32 + s[1] for c, s in out.items()}


def spiral(n):
    """A spiral of 1 in 0, one pixel wide, so that its ends meet only through many blocks."""
    a = np.zeros((n, n), int)
    y, x, dy, dx = 0, 0, 0, 1
    a[0, 0] = 1
    while True:
        for _ in range(2):
            ny, nx, fy, fx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
            if not (0 <= ny < n and 0 <= nx < n) or (0 <= fy < n and 0 <= fx < n and a[fy, fx]):
                dy, dx = dx, -dy
            else:
                break
        else:
            break
        y, x = y + dy, x + dx
        if a[y, x]:
            break
        a[y, x] = 1
    return {(i, j): int(a[i, j]) for i in range(n) for j in range(n)}


GRIDS = {
    "noise": {(y, x): int(v) for (y, x), v in np.ndenumerate(np.random.default_rng(3).integers(0, 2, (23, 19)))},
    "holes": {(y, x): int(v) for (y, x), v in np.ndenumerate(np.random.default_rng(4).integers(0, 3, (17, 21))) if (y * 7 + x) % 5},
    "solid": {(y, x): 7 for y in range(20) for x in range(20)},
    "spiral": spiral(21),
}


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("name", sorted(GRIDS))
def test_components_across_blocks(spark, name, diagonal):
    cells = GRIDS[name]
    got = {(r["y"], r["x"]): (r["comp"], r["cls"]) for r in focal.components(frame(spark, cells), diagonal, block=5).collect()}
    want = flood(cells, diagonal)
    assert got == {c: (want[c], cells[c]) for c in cells}


def test_objects_and_small_ones(spark):
    cells = GRIDS["holes"]
    for diagonal in (False, True):
        want = flood(cells, diagonal)
        groups = {}
        for c, s in want.items():
            groups.setdefault(s, []).append(c)
        got = {tuple(r) for r in focal.objects(frame(spark, cells), 2, 9, diagonal, None, block=4).collect()}
        box = lambda s, g: (s, cells[g[0]], len(g), min(g)[0], min(x for _, x in g), max(g)[0], max(x for _, x in g))
        assert got == {box(s, g) for s, g in groups.items() if 2 <= len(g) <= 9}
        got = {(r["y"], r["x"]): r["cls"] for r in focal.remove_small(frame(spark, cells), 4, -1, diagonal, block=4).collect()}
        assert got == {c: v if len(groups[want[c]]) >= 4 else -1 for c, v in cells.items()}


def test_regions_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(0, 0, None), (0, 1, 1), (0, 1, 1), (0, 2, 1)], "y int, x int, cls int")
    assert sorted(map(tuple, focal.components(df).collect())) == [(0, 1, 1, 1), (0, 2, 1, 1)]
    for empty in (df.limit(0), df.filter("cls is null")):
        assert focal.components(empty).count() == focal.remove_small(empty).count() == focal.objects(empty, 1, 9).count() == 0


def in_order(cells, passes, window, gap=0):
    """The sequential loop: all gaps in row order, each by the present state of its window, ``passes`` times."""
    now, r = dict(cells), window // 2
    gaps = sorted(c for c, v in cells.items() if v == gap)
    for _ in range(passes):
        for y, x in gaps:
            near = [now[c] for c in ((y + i, x + j) for i in range(-r, r + 1) for j in range(-r, r + 1)) if now.get(c, gap) not in (gap, None)]
            if near:
                now[y, x] = min(set(near), key=lambda v: (-near.count(v), v))
    return now


def holed(seed, h, w, share):
    rng = np.random.default_rng(seed)
    a = rng.choice([10, 20, 30], (h, w))
    a[rng.random((h, w)) < share] = 0
    a[h // 3 : h // 2, 2 : w - 2] = 0  # wider than a window: filled from its rim inwards, in order
    return {(y, x): int(v) for (y, x), v in np.ndenumerate(a) if (y, x) != (1, 1)}


@pytest.mark.parametrize("seed,h,w,share,passes,window,block", [(1, 24, 17, 0.3, 3, 7, 8), (2, 31, 29, 0.6, 2, 3, 5), (3, 40, 12, 0.9, 4, 5, 6), (4, 18, 18, 0.5, 1, 7, 256)])
def test_gaps_fill_as_in_a_loop(spark, seed, h, w, share, passes, window, block):
    """Chains of dependence across many blocks; missing pixels count for nothing."""
    cells = holed(seed, h, w, share)
    got = {(r["y"], r["x"]): r["cls"] for r in focal.fill_gaps_in_order(frame(spark, cells), h, w, passes, window, block=block).collect()}
    assert got == in_order(cells, passes, window)


def test_gaps_without_any_class_and_without_gaps(spark):
    for cells in ({(y, x): 0 for y in range(6) for x in range(6)}, {(y, x): 5 for y in range(6) for x in range(6)}):
        for passes in (0, 2):
            got = {(r["y"], r["x"]): r["cls"] for r in focal.fill_gaps_in_order(frame(spark, cells), 6, 6, passes, 3, block=4).collect()}
            assert got == cells
    assert focal.fill_gaps_in_order(frame(spark, {(0, 0): 1}).limit(0), 6, 6, 2).count() == 0


@pytest.mark.parametrize("lowest", [0, 10])
def test_post_processing_chain(spark, lowest):
    """Small objects go, their gaps are filled in order, once for each class that is left; not where class 0 occurs itself."""
    rng = np.random.default_rng(9)
    a = rng.choice([lowest, 20, 30], (40, 33), p=[0.3, 0.4, 0.3])
    cells = {(y, x): int(v) for (y, x), v in np.ndenumerate(a)}
    df = frame(spark, cells)
    smoothed = {(r["y"], r["x"]): r["cls"] for r in focal.smooth(df, 40, 33, 5).collect()}
    where, size = flood(smoothed, False), {}
    for s in where.values():
        size[s] = size.get(s, 0) + 1
    left = {c: v if size[where[c]] >= 12 else 0 for c, v in smoothed.items()}
    assert 0 in left.values() and any(v != smoothed[c] for c, v in left.items())
    want = left if 0 in smoothed.values() else in_order(left, len(set(left.values()) - {0}), 5)
    got = {(r["y"], r["x"]): r["cls"] for r in focal.post_process(df, 40, 33, 5, 12).collect()}
    assert got == want
