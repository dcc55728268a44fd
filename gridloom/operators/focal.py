"""Neighbourhood operators: box filters, majority, components, gap filling.

Class filters deal pixels to square blocks, those near a block's side to both,
and filter a block in one pass; a block's size bounds what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import clamp_index
from gridloom.operators.graph import _cut, connected_components

#: What packed blocks hold where there is no pixel.
ABSENT = -(2**31)


def _reflected(v: Column, n: int, r: int) -> Column:
    """The targets within r of index v on 0..n-1, with multiplicity, when the border repeats its edge.

    Reflection with a repeated edge is its own mirror: v counts for target t as
    often as the images of v (v, -v - 1, 2n - 1 - v) lie within r of t.
    """
    reach = lambda c: F.when((c + r >= 0) & (c - r <= n - 1), F.sequence(F.greatest(c - r, F.lit(0)), F.least(c + r, F.lit(n - 1)))).otherwise(F.array().cast("array<int>"))
    return F.concat(reach(v), reach(-v - 1), reach(2 * n - 1 - v))


def _blocks_of(p: DataFrame, height: int, width: int, r: int, block: int) -> DataFrame:
    """``p`` with by, bx: each row once for every block that holds its pixel or has it within r."""

    def of(v: Column, n: int) -> Column:
        at = lambda d: clamp_index(F.floor((v + d) / block).cast("int"), -(-n // block))
        return F.array_distinct(F.sequence(at(-r), at(r)))

    return p.select(F.explode(of(F.col("y"), height)).alias("by"), "*").select(F.explode(of(F.col("x"), width)).alias("bx"), "*")


def _dealt(df: DataFrame, height: int, width: int, r: int, block: int, col: str) -> DataFrame:
    """(by, bx, y, x, cls): each pixel once for every block that holds it or has it within r."""
    p = df.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(col).cast("int").alias("cls")).filter("cls is not null")
    return _blocks_of(p, height, width, r, block)


def _commonest(df: DataFrame, height: int, width: int, window: int, col: str, block: int, reflect: bool) -> DataFrame:
    """(y, x, cls): the most frequent class of each window, the smallest of ties.

    One exchange of pixels with their halo; a block is then filtered in one pass
    by running sums for each class in it.  Pixels that aren't there (or have a
    null class) count for nothing; places with no pixel in reach have no row.
    """
    r = window // 2

    def kernel(key, t):
        import numpy as np
        import pyarrow as pa

        by, bx = (k.as_py() for k in key)
        y0, x0 = by * block, bx * block
        ny, nx = min(block, height - y0), min(block, width - x0)
        y, x, cls = (t.column(c).to_numpy() for c in ("y", "x", "cls"))
        kinds, code = np.unique(cls, return_inverse=True)
        held = np.full((ny + 2 * r, nx + 2 * r), -1)
        held[y - (y0 - r), x - (x0 - r)] = code

        def source(start, n, size):
            i = np.arange(start - r, start + n + r)
            i = np.minimum(i % (2 * size), -i - 1 + 2 * size * (i // (2 * size) + 1)) if reflect else np.clip(i, 0, size - 1)
            return i - (start - r)

        held = held[np.ix_(source(y0, ny, height), source(x0, nx, width))]
        best, top = np.zeros((ny, nx), int), np.zeros((ny, nx), int)
        for k in range(len(kinds)):
            s = np.pad(np.cumsum(np.cumsum(held == k, axis=0), axis=1), ((1, 0), (1, 0)))
            d = 2 * r + 1
            n = s[d:, d:] - s[:-d, d:] - s[d:, :-d] + s[:-d, :-d]
            more = n > best
            best[more], top[more] = n[more], k
        at = np.nonzero(best)
        out = [at[0] + y0, at[1] + x0, kinds[top[at]]]
        return pa.table([pa.array(v.astype("int32")) for v in out], names=["y", "x", "cls"])

    return _dealt(df, height, width, r, block, col).groupBy("by", "bx").applyInArrow(kernel, "y int, x int, cls int")


def _top(counts: DataFrame) -> DataFrame:
    m = F.max(F.struct("n", (-F.col("cls")).alias("c")))
    return counts.groupBy("y", "x").agg(m.alias("m")).select("y", "x", (-F.col("m.c")).cast("int").alias("cls"))


def mean_filter_argmax(df: DataFrame, height: int, width: int, window: int = 7, col: str = "cls", block: int = 256) -> DataFrame:
    """(y, x, cls): the class with the largest mean in the window (odd), border reflected, the smallest of ties."""
    return _commonest(df, height, width, window, col, block, reflect=True)


def majority_filter(df: DataFrame, height: int, width: int, window: int = 3, col: str = "cls", block: int = 256) -> DataFrame:
    """(y, x, cls): the most frequent class in the window (odd), edge pixels repeated, the smallest of ties."""
    return _commonest(df, height, width, window, col, block, reflect=False)


def smooth(df: DataFrame, height: int, width: int, window: int = 7, col: str = "cls") -> DataFrame:
    """The mean filter and then the 3 x 3 majority."""
    return majority_filter(mean_filter_argmax(df, height, width, window, col), height, width, 3)


def high_pass(df: DataFrame, height: int, width: int, value: str = "value") -> DataFrame:
    """(y, x, value): 3 x 3 kernel of -1/9 around 9/9, border reflected, in double precision."""
    a = df.select(F.explode(_reflected(F.col("y").cast("int"), height, 1)).alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("v"))
    a = a.groupBy("y", "x").agg(F.sum("v").alias("v"))
    b = a.select("y", F.explode(_reflected(F.col("x"), width, 1)).alias("x"), "v").groupBy("y", "x").agg(F.sum("v").alias("s"))
    j = df.select("y", "x", F.col(value).cast("double").alias("v")).join(b, ["y", "x"])
    return j.select("y", "x", ((10 * F.col("v") - F.col("s")) / 9).alias(value))


def sharpen_high_pass(df: DataFrame, high: DataFrame, height: int, width: int, value: str = "value", weight: float = 0.7) -> DataFrame:
    """Adds the mean-centred high-pass of ``high`` at ``weight``, clipped to the range of ``value``."""
    h = high_pass(high, height, width, value).select("y", "x", F.col(value).alias("_h"))
    s = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    m = h.agg(F.avg("_h").alias("_m"))
    j = df.join(h, ["y", "x"]).crossJoin(F.broadcast(s)).crossJoin(F.broadcast(m))  # one-row sides
    v = F.col(value) + weight * (F.col("_h") - F.col("_m"))
    return j.select("y", "x", F.greatest("_lo", F.least("_hi", v)).alias(value))


def _labelled(df: DataFrame, diagonal: bool, col: str, block: int) -> DataFrame:
    """(y, x, cls, label): pixels of one class that are connected inside their block; label is the smallest pixel number of theirs there."""

    def kernel(key, t):
        import numpy as np
        import pyarrow as pa

        y, x, cls = (t.column(c).to_numpy() for c in ("y", "x", "cls"))
        y0, x0 = key[0].as_py() * block, key[1].as_py() * block
        there, held = np.zeros((block, block), bool), np.zeros((block, block), np.int64)
        there[y - y0, x - x0], held[y - y0, x - x0] = True, cls
        at = np.full((block, block), -1)
        cells = np.nonzero(there)
        at[cells] = np.arange(len(cells[0]))
        links = []
        for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if diagonal else 2]:
            a = (slice(0, block - dy), slice(max(0, -dx), block - max(0, dx)))
            b = (slice(dy, block), slice(max(0, dx), block + min(0, dx)))
            same = there[a] & there[b] & (held[a] == held[b])
            links.append(np.stack([at[a][same], at[b][same]]))
        u, v = np.concatenate(links, 1)
        label = np.arange(len(cells[0]))
        while True:
            a, b = label[u], label[v]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)  # roots hang below the smaller ones they meet
            np.minimum.at(label, b, low)
            while (label != label[label]).any():
                label = label[label]
        number = (cells[0] + y0).astype(np.int64) * (1 << 32) + cells[1] + x0
        out = [(cells[0] + y0).astype("int32"), (cells[1] + x0).astype("int32"), held[cells].astype("int32"), number[label]]
        return pa.table([pa.array(c) for c in out], names=["y", "x", "cls", "label"])

    p = df.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(col).cast("int").alias("cls")).filter("cls is not null")
    by = [F.floor(F.col(c) / block).cast("int").alias(f"b{c}") for c in "yx"]
    return p.select(*by, "*").groupBy("by", "bx").applyInArrow(kernel, "y int, x int, cls int, label long")


def _regions(df: DataFrame, diagonal: bool, col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(pixels with their label inside a block; label and comp of labels that touch another block's)."""
    p = _cut(_labelled(df, diagonal, col, block))
    side = lambda c, k: F.pmod(F.col(c), F.lit(block)) == k
    rim = p.filter(side("y", 0) | side("y", block - 1) | side("x", 0) | side("x", block - 1))
    offsets = [(0, -1), (-1, 0)] + ([(-1, -1), (-1, 1)] if diagonal else [])
    o = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    to = rim.select(F.col("label").alias("a"), "cls", "y", "x", F.explode(o).alias("o"))
    block_of = lambda c: F.floor(F.col(c) / block)
    to = to.select("a", "cls", (F.col("y") + F.col("o.dy")).alias("_y"), (F.col("x") + F.col("o.dx")).alias("_x"), block_of("y").alias("_by"), block_of("x").alias("_bx"))
    to = to.filter((block_of("_y") != F.col("_by")) | (block_of("_x") != F.col("_bx"))).select("a", "cls", F.col("_y").alias("y"), F.col("_x").alias("x"))
    edges = to.join(rim.select(F.col("label").alias("b"), "cls", "y", "x"), ["cls", "y", "x"]).select("a", "b").distinct()
    return p, connected_components(edges).select(F.col("node").alias("label"), F.col("component").alias("comp"))


def components(df: DataFrame, diagonal: bool = False, col: str = "cls", block: int = 256) -> DataFrame:
    """(y, x, cls, comp): connected pixels of one class; comp is the smallest pixel number y * 2^32 + x.

    Blocks are labelled in one pass each, and only labels that meet across a
    block's side become edges of a graph, so a solid area costs its rim alone.
    Pixels without a class have no row; of repeated pixels one counts.
    """
    p, c = _regions(df, diagonal, col, block)
    return p.join(c, "label", "left").select("y", "x", "cls", F.coalesce("comp", "label").alias("comp"))


def objects(df: DataFrame, least: int, most: int, diagonal: bool = True, background: int | None = 0, block: int = 256) -> DataFrame:
    """(comp, cls, area, y0, x0, y1, x1) of components whose area lies in [least, most]."""
    d = df if background is None else df.filter(F.col("cls") != background)
    p, c = _regions(d, diagonal, "cls", block)
    ends = [F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1")]
    parts = p.groupBy("label", "cls").agg(F.count("*").alias("area"), *ends)  # by block first: a large component is many labels
    whole = parts.join(c, "label", "left").groupBy(F.coalesce("comp", "label").alias("comp"), "cls")
    g = whole.agg(F.sum("area").alias("area"), F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"))
    return g.filter(F.col("area").between(least, most))


def remove_small(df: DataFrame, least: int = 20, fill: int = 0, diagonal: bool = False, block: int = 256) -> DataFrame:
    """Components of fewer than ``least`` pixels become ``fill``; pixels without a class have no row."""
    p, c = _regions(df, diagonal, "cls", block)
    parts = p.groupBy("label").agg(F.count("*").alias("_n")).join(c, "label", "left").select("label", "_n", F.coalesce("comp", "label").alias("comp"))
    area = parts.groupBy("comp").agg(F.sum("_n").alias("_area"))
    few = parts.join(area.filter(F.col("_area") < least), "comp").select("label", F.lit(True).alias("_few"))
    return p.join(few, "label", "left").select("y", "x", F.when(F.col("_few"), F.lit(fill)).otherwise(F.col("cls")).cast("int").alias("cls"))


def fill_gaps(df: DataFrame, height: int, width: int, window: int = 7, gap: int = 0) -> DataFrame:
    """Pixels of class ``gap`` take the most frequent other class in the window, all at once.

    Reads the original classes alone (a synchronous pass); a gap without
    another class around it stays.
    """
    r = window // 2
    k = F.sequence(F.lit(-r), F.lit(r))
    holes = df.filter(F.col("cls") == gap).select("y", "x", F.explode(k).alias("dy")).select("y", "x", "dy", F.explode(k).alias("dx"))
    near = holes.select("y", "x", (F.col("y") + F.col("dy")).alias("_y"), (F.col("x") + F.col("dx")).alias("_x"))
    v = df.filter(F.col("cls") != gap).select(F.col("y").alias("_y"), F.col("x").alias("_x"), "cls")
    best = _top(near.join(v, ["_y", "_x"]).groupBy("y", "x", "cls").agg(F.count("*").alias("n"))).withColumnRenamed("cls", "_f")
    return df.join(best, ["y", "x"], "left").select("y", "x", F.coalesce("_f", "cls").alias("cls"))


def fill_gaps_in_order(df: DataFrame, height: int, width: int, passes: int, window: int = 7, gap: int = 0, block: int = 256) -> DataFrame:
    """(y, x, cls): ``passes`` times over all gaps in row order, each taking the most frequent class in its window as that is by then.

    A gap sees what was filled before it, in this pass or an earlier one; ties go
    to the smallest class, and a gap without any class around it stays for now.
    Values depend on earlier ones alone, so they have one solution.  Blocks fill
    their own gaps in order against what neighbours had in each pass, and go over
    them again until no block's rim changes: that is the solution, found in as many
    rounds as the longest chain of dependence crosses blocks.
    """
    r = window // 2

    def pack(key, t):
        import numpy as np
        import pyarrow as pa

        y0, x0 = key[0].as_py() * block - r, key[1].as_py() * block - r
        y, x, cls = (t.column(c).to_numpy() for c in ("y", "x", "cls"))
        inner = (y >= y0 + r) & (y < y0 + r + block) & (x >= x0 + r) & (x < x0 + r + block)
        if not (inner & (cls == gap)).any():
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["by", "bx", "held"])
        held = np.full((block + 2 * r, block + 2 * r), ABSENT, np.int32)
        held[y - y0, x - x0] = cls
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["by", "bx", "held"])

    def fill(key, own, rim):
        import numpy as np
        import pyarrow as pa

        names = ["y", "x", "past"]
        if not own.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.int32()))], names=names)
        y0, x0 = key[0].as_py() * block - r, key[1].as_py() * block - r
        held = np.frombuffer(own.column("held")[0].as_py(), np.int32).reshape(block + 2 * r, block + 2 * r)
        known = np.zeros((0, passes), np.int32)
        told = {}
        if rim.num_rows:
            known = np.array(rim.column("past").to_pylist(), np.int32).reshape(-1, passes)
            told = {(y - y0, x - x0): k for k, (y, x) in enumerate(zip(rim.column("y").to_pylist(), rim.column("x").to_pylist()))}
        kinds = np.unique(np.concatenate([held.ravel(), known.ravel()]))
        kinds = kinds[(kinds != ABSENT) & (kinds != gap)]
        code = lambda v: np.where((v == ABSENT) | (v == gap), 0, np.searchsorted(kinds, v) + 1)
        now, known = code(held), code(known)
        order = np.argwhere(held == gap).tolist()
        mine = [(y, x) for y, x in order if r <= y < r + block and r <= x < r + block]
        past = np.zeros((len(mine), passes), np.int32)
        for k in range(passes):
            n = 0
            for y, x in order:
                if r <= y < r + block and r <= x < r + block:
                    count = np.bincount(now[y - r : y + r + 1, x - r : x + r + 1].ravel())
                    count[0] = 0
                    if len(count) > 1 and count.any():
                        now[y, x] = count.argmax()
                    past[n, k] = now[y, x]
                    n += 1
                elif (y, x) in told:
                    now[y, x] = known[told[y, x], k]
        value = np.concatenate([[gap], kinds]).astype(np.int32)[past]
        at = np.array(mine, np.int32)
        offsets = pa.array(np.arange(0, len(mine) * passes + 1, passes), pa.int32())
        return pa.table([pa.array(at[:, 0] + y0), pa.array(at[:, 1] + x0), pa.ListArray.from_arrays(offsets, pa.array(value.ravel()))], names=names)

    if passes < 1:
        return df.select("y", "x", "cls")
    static = _cut(_dealt(df, height, width, r, block, "cls").groupBy("by", "bx").applyInArrow(pack, "by int, bx int, held binary"))
    none = df.sparkSession.createDataFrame([], "by int, bx int, y int, x int, past array<int>")
    rim, before = none, None
    while True:
        filled = _cut(static.groupBy("by", "bx").cogroup(rim.groupBy("by", "bx")).applyInArrow(fill, "y int, x int, past array<int>"))
        dealt = _blocks_of(filled, height, width, r, block).filter((F.col("by") != F.floor(F.col("y") / block)) | (F.col("bx") != F.floor(F.col("x") / block)))
        rim = dealt.select("by", "bx", "y", "x", "past")
        state = rim.agg(F.count("*"), F.sum(F.xxhash64("by", "bx", "y", "x", "past").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
    last = filled.select("y", "x", F.element_at("past", passes).alias("_f"))
    return df.select("y", "x", F.col("cls").cast("int").alias("cls")).join(last, ["y", "x"], "left").select("y", "x", F.coalesce("_f", "cls").alias("cls"))


def post_process(df: DataFrame, height: int, width: int, window: int = 7, least: int = 20) -> DataFrame:
    """Smoothing, removal of small components, and filling of the gaps they leave, in order.

    Gaps are class 0; they are filled once for each class of the smoothed map that
    is left, and not at all where that map holds class 0 itself.
    """
    smoothed = _cut(smooth(df, height, width, window))
    left = _cut(remove_small(smoothed, least))
    classes = {r["cls"] for r in smoothed.select("cls").distinct().collect()}
    still = {r["cls"] for r in left.select("cls").distinct().collect()} - {0}
    if 0 in classes:
        return left
    return fill_gaps_in_order(left, height, width, len(still), window)
