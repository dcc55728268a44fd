"""Seeded augmentation of patches, a row a patch: flips, quarter turns, shift-scale-rotate, contrast and brightness.

What happens to a patch is drawn from a seed and its key by a portable hash, so it
is the same under any partitioning and in any engine.  Bands are taken bilinear,
masks by the nearest pixel, from the patch mirrored at its edges (the edge pixel
not repeated).  No row is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.normalize import even
from gridloom.sources.storage import ship


@dataclass(frozen=True)
class Ranges:
    """Shares of patches that are changed, and how far."""

    flip: float = 0.5
    turn: float = 0.5
    affine: float = 0.2
    tone: float = 0.5
    degrees: float = 10.0
    scale: float = 0.05
    shift: float = 0.0625
    contrast: float = 0.2
    brightness: float = 0.2


def drawn(patches: DataFrame, key: str, ranges: Ranges = Ranges(), seed: int = 0) -> DataFrame:
    """``patches`` with what is drawn for each: hflip, vflip, turns (0 to 3), angle (radians), zoom, down, right (of a side), gain, lift."""
    u = lambda k: even(seed + k, F.col(key))
    r = ranges
    some = lambda k, share, v, otherwise: F.when(u(k) < share, v).otherwise(F.lit(otherwise))
    both = lambda k: 2 * u(k) - 1
    return patches.withColumns(
        {
            "hflip": u(1) < r.flip, "vflip": u(2) < r.flip, "turns": some(3, r.turn, F.floor(u(4) * 4), 0).cast("int"),
            "angle": some(5, r.affine, F.radians(both(6) * r.degrees), 0.0), "zoom": some(5, r.affine, 1 + both(7) * r.scale, 1.0),
            "down": some(5, r.affine, both(8) * r.shift, 0.0), "right": some(5, r.affine, both(9) * r.shift, 0.0),
            "gain": some(10, r.tone, 1 + both(11) * r.contrast, 1.0), "lift": some(10, r.tone, both(12) * r.brightness, 0.0),
        }
    )


DRAWS = ("hflip", "vflip", "turns", "angle", "zoom", "down", "right", "gain", "lift")


def sources(n: int, hflip: bool, vflip: bool, turns: int, angle: float, zoom: float, down: float, right: float):
    """(rows, columns) in the patch that each pixel of the result is taken from, as arrays of n x n."""
    import numpy as np

    c = (n - 1) / 2
    y, x = np.mgrid[0:n, 0:n] - c
    y, x = y - down * n, x - right * n
    y, x = (np.cos(angle) * y - np.sin(angle) * x) / zoom, (np.sin(angle) * y + np.cos(angle) * x) / zoom
    for _ in range(turns):
        y, x = x, -y
    return (-y if vflip else y) + c, (-x if hflip else x) + c


def mirrored(i, n: int):
    """Indices folded into 0..n-1 without repeating the edge, however far out."""
    import numpy as np

    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.minimum(i, 2 * n - 2 - i)


def warp_patches(patches: DataFrame, size: int, *, bands: str = "bands", mask: str = "mask") -> DataFrame:
    """``patches`` with bands (an array of bands, each size * size values by row) and mask changed as :func:`drawn` says.

    A null patch or mask stays null, and one of another size raises; a null or NaN
    value leaves what is taken from it NaN.  Mask classes are never mixed.
    """
    import pyarrow as pa

    ship(patches.sparkSession)
    names = patches.columns

    def rows(batches):
        import numpy as np

        def changed(values, found, m, draw):
            r, c = found
            r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
            if values is not None:
                a = np.array(values, float).reshape(-1, size, size)
                out = np.zeros_like(a)
                for i in (0, 1):
                    for j in (0, 1):
                        w = (1 - np.abs(r - r0 - i)) * (1 - np.abs(c - c0 - j))
                        got = a[:, mirrored(r0 + i, size), mirrored(c0 + j, size)]
                        out += np.where(w > 0, w * got, 0)
                values = (out * draw["gain"] + draw["lift"]).reshape(len(a), -1).tolist()
            if m is not None:
                k = np.array(m).reshape(size, size)
                m = k[mirrored(np.floor(r + 0.5).astype(int), size), mirrored(np.floor(c + 0.5).astype(int), size)].ravel().tolist()
            return values, m

        for b in batches:
            t = pa.Table.from_batches([b])
            draws = t.select(list(DRAWS)).to_pylist()
            new = [changed(v, sources(size, *[d[k] for k in DRAWS[:7]]), m, d) for v, m, d in zip(t.column(bands).to_pylist(), t.column(mask).to_pylist(), draws)]
            for name, at in ((bands, 0), (mask, 1)):
                t = t.set_column(names.index(name), t.schema.field(name), pa.array([v[at] for v in new], t.schema.field(name).type))
            yield from t.to_batches()

    return patches.mapInArrow(rows, patches.schema)


def augment(patches: DataFrame, size: int, key: str, *, ranges: Ranges = Ranges(), seed: int = 0, bands: str = "bands", mask: str = "mask") -> DataFrame:
    """``patches`` augmented once; the columns that were drawn are dropped again.

    A null key draws nothing and gives null draws, so such patches raise; rows of
    one key are changed alike.  Columns named as a draw are refused.
    """
    taken = set(DRAWS) & set(patches.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are names of draws")
    p = patches.withColumn(bands, F.col(bands).cast("array<array<double>>")).withColumn(mask, F.col(mask).cast("array<int>"))
    return warp_patches(drawn(p, key, ranges, seed), size, bands=bands, mask=mask).drop(*DRAWS)
