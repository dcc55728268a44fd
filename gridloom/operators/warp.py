"""Resampling of a raster on the grid of another coordinate system.

Coordinates are geographic (EPSG:4326, longitude and latitude in degrees) or in a
transverse Mercator zone of WGS 84 (EPSG:326zz north, 327zz south), by the series
in the third flattening, good to well below a millimetre inside a zone.

A target pixel's centre is mapped back to a place in the source; the taps there
don't separate by axis.  Target blocks find the source blocks that their places
touch, each source pixel goes to the blocks that need it in one exchange, and a
task then holds one target block and the source around it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.storage import ship

# WGS 84 and the universal transverse Mercator grid.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0

# Coefficients of n, n**2, n**3, n**4 in the series of the conformal latitude (forth, back).
FORTH = [
    (1 / 2, -2 / 3, 5 / 16, 41 / 180),
    (0.0, 13 / 48, -3 / 5, 557 / 1440),
    (0.0, 0.0, 61 / 240, -103 / 140),
    (0.0, 0.0, 0.0, 49561 / 161280),
]
BACK = [
    (1 / 2, -2 / 3, 37 / 96, -1 / 360),
    (0.0, 1 / 48, 1 / 15, -437 / 1440),
    (0.0, 0.0, 17 / 480, -37 / 840),
    (0.0, 0.0, 0.0, 4397 / 161280),
]


def third_flattening() -> float:
    return FLATTENING / (2 - FLATTENING)


def series(table) -> list[float]:
    """The coefficients of sin 2k and cos 2k for k = 1 to 4."""
    n = third_flattening()
    return [sum(c * n ** (i + 1) for i, c in enumerate(row)) for row in table]


def rectifying_radius() -> float:
    n = third_flattening()
    return SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


@dataclass(frozen=True)
class System:
    """A coordinate system by its code; zone is None for geographic coordinates."""

    zone: int | None
    south: bool = False

    @classmethod
    def of(cls, code: str) -> "System":
        number = int(code.rpartition(":")[2])
        if number == 4326:
            return cls(None)
        if number // 100 in (326, 327) and 1 <= number % 100 <= 60:
            return cls(number % 100, number // 100 == 327)
        raise ValueError(f"{code} is neither EPSG:4326 nor a zone of EPSG:326zz or 327zz")

    def meridian(self) -> float:
        """The central meridian in degrees."""
        return 6.0 * self.zone - 183.0

    def to_degrees(self, x, y):
        """(longitude, latitude) of map coordinates; arrays or numbers."""
        import numpy as np

        if self.zone is None:
            return x, y
        radius = SCALE * rectifying_radius()
        xi, eta = (y - (FALSE_NORTHING if self.south else 0.0)) / radius, (x - FALSE_EASTING) / radius
        u, v = xi, eta
        for k, b in enumerate(series(BACK), 1):
            u = u - b * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
            v = v - b * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
        tau = conformal_back(np.sin(u) / np.hypot(np.sinh(v), np.cos(u)))
        return self.meridian() + np.degrees(np.arctan2(np.sinh(v), np.cos(u))), np.degrees(np.arctan(tau))

    def from_degrees(self, longitude, latitude):
        """Map coordinates of (longitude, latitude) in degrees."""
        import numpy as np

        if self.zone is None:
            return longitude, latitude
        e = np.sqrt(FLATTENING * (2 - FLATTENING))
        turn = np.radians((longitude - self.meridian() + 180.0) % 360.0 - 180.0)
        s = np.sin(np.radians(latitude))
        t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
        xi, eta = np.arctan2(t, np.cos(turn)), np.arcsinh(np.sin(turn) / np.hypot(t, np.cos(turn)))
        u, v = xi, eta
        for k, a in enumerate(series(FORTH), 1):
            u = u + a * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
            v = v + a * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
        radius = SCALE * rectifying_radius()
        return FALSE_EASTING + radius * v, (FALSE_NORTHING if self.south else 0.0) + radius * u


def conformal_back(t, steps: int = 5):
    """The tangent of the latitude from that of the conformal one, by Newton steps (the third is exact in double precision)."""
    import numpy as np

    e2 = FLATTENING * (2 - FLATTENING)
    e = np.sqrt(e2)
    tau = t / np.sqrt(1 - e2)
    for _ in range(steps):
        s = np.sinh(e * np.arctanh(e * tau / np.hypot(1, tau)))
        now = tau * np.hypot(1, s) - s * np.hypot(1, tau)
        tau = tau + (t - now) / np.hypot(1, now) * (1 + (1 - e2) * tau**2) / ((1 - e2) * np.hypot(1, tau))
    return tau


@dataclass(frozen=True)
class Grid:
    """Size, system, corner and step of a raster."""

    height: int
    width: int
    crs: str
    x0: float
    y0: float
    dx: float
    dy: float

    @classmethod
    def of(cls, meta: DataFrame) -> "Grid":
        """From the one metadata row of ``blocks.metadata`` (or of a file)."""
        return cls(*[meta.first()[c] for c in ("height", "width", "crs", "x0", "y0", "dx", "dy")])

    def places(self, other: "Grid", rows, columns):
        """Fractional (row, column) in ``other`` of the centres of own pixels; whole numbers are centres there."""
        x, y = self.x0 + (columns + 0.5) * self.dx, self.y0 + (rows + 0.5) * self.dy
        if self.crs != other.crs:
            x, y = System.of(other.crs).from_degrees(*System.of(self.crs).to_degrees(x, y))
        return (y - other.y0) / other.dy - 0.5, (x - other.x0) / other.dx - 0.5


def covering_grid(source: Grid, crs: str, step: tuple[float, float]) -> Grid:
    """The grid of ``crs`` and ``step`` around ``source``, from its border's places; its corner is a multiple of the step."""
    import numpy as np

    h, w = source.height, source.width
    # pixel corners along the border
    r = np.concatenate([np.zeros(w + 1), np.full(w + 1, h), np.arange(h + 1), np.arange(h + 1)])
    c = np.concatenate([np.arange(w + 1), np.arange(w + 1), np.zeros(h + 1), np.full(h + 1, w)])
    x, y = System.of(crs).from_degrees(*System.of(source.crs).to_degrees(source.x0 + c * source.dx, source.y0 + r * source.dy))
    dx, dy = step
    first = [np.floor(np.min(v / d)) for v, d in ((x, dx), (y, dy))]
    last = [np.ceil(np.max(v / d)) for v, d in ((x, dx), (y, dy))]
    return Grid(int(last[1] - first[1]), int(last[0] - first[0]), crs, float(first[0] * dx), float(first[1] * dy), dx, dy)


def warp(pixels: DataFrame, source: Grid, target: Grid, *, method: str = "bilinear", keys: tuple[str, ...] = ("band",), block: int = 256) -> DataFrame:
    """(keys, y, x, value) of ``pixels`` (keys, y, x, value) on the ``target`` grid.

    ``bilinear`` weighs the two by two pixels around a place, leaving out those that
    are absent or null and sharing their weight; ``nearest`` takes the pixel that
    holds the place.  Places outside the source's pixels give no row, nor do those
    without a pixel around them.  Of repeated pixels one counts.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(method)
    spark = pixels.sparkSession
    ship(spark)
    down, across = -(-target.height // block), -(-target.width // block)
    reach = 1 if method == "bilinear" else 0

    def needs(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                ty, tx = divmod(k, across)
                y, x = target_block(ty, tx)
                r, c = target.places(source, y, x)
                inside = (r >= -0.5) & (r < source.height - 0.5) & (c >= -0.5) & (c < source.width - 0.5)
                if not inside.any():
                    continue
                corners = [(np.clip(np.floor(r[inside]) + dr, 0, source.height - 1) // block, np.clip(np.floor(c[inside]) + dc, 0, source.width - 1) // block) for dr in (0, 1) for dc in (0, 1)]
                found = np.unique(np.concatenate([np.stack(p, 1) for p in corners]).astype(int), axis=0)
                out += [(ty, tx, int(sy), int(sx)) for sy, sx in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in zip(*out)], names=["ty", "tx", "sy", "sx"])

    def target_block(ty, tx):
        import numpy as np

        return np.meshgrid(np.arange(ty * block, min((ty + 1) * block, target.height)), np.arange(tx * block, min((tx + 1) * block, target.width)), indexing="ij")

    def kernel(key, t):
        import numpy as np
        import pyarrow as pa

        ty, tx = key[0].as_py(), key[1].as_py()
        y, x = target_block(ty, tx)
        r, c = target.places(source, y, x)
        inside = (r >= -0.5) & (r < source.height - 0.5) & (c >= -0.5) & (c < source.width - 0.5)
        sy, sx, v = (t.column(n).to_numpy(zero_copy_only=False) for n in ("y", "x", "value"))
        a, b = int(sy.min()) - 1, int(sx.min()) - 1
        held = np.full((int(sy.max()) - a + 2, int(sx.max()) - b + 2), np.nan)
        held[sy - a, sx - b] = v
        total, weight = np.zeros(r.shape), np.zeros(r.shape)
        r0, c0 = (np.floor(r), np.floor(c)) if reach else (np.floor(r + 0.5), np.floor(c + 0.5))
        for dr in range(reach + 1):
            for dc in range(reach + 1):
                w = (1 - abs(r - r0 - dr)) * (1 - abs(c - c0 - dc)) if reach else np.ones(r.shape)
                i, j = (r0 + dr - a).astype(int), (c0 + dc - b).astype(int)
                there = (i >= 0) & (i < held.shape[0]) & (j >= 0) & (j < held.shape[1]) & inside
                got = np.where(there, held[np.where(there, i, 0), np.where(there, j, 0)], np.nan)
                known = ~np.isnan(got) & (w > 0)
                total += np.where(known, w * got, 0)
                weight += np.where(known, w, 0)
        some = weight > 0
        n = int(some.sum())
        told = [pa.array([k.as_py()] * n, k.type) for k in key[2:]]
        return pa.table([*told, pa.array(y[some].astype(np.int32)), pa.array(x[some].astype(np.int32)), pa.array(total[some] / weight[some])], names=[*keys, "y", "x", "value"])

    need = spark.range(down * across).mapInArrow(needs, "ty int, tx int, sy int, sx int")
    own = [F.floor(F.col(c) / block).cast("int").alias(f"s{c}") for c in "yx"]
    p = pixels.filter(F.col("value").isNotNull()).select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    p = p.filter(F.col("y").between(0, source.height - 1) & F.col("x").between(0, source.width - 1))
    kinds = dict(p.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["y int", "x int", "value double"])
    return p.select("*", *own).join(need, ["sy", "sx"]).groupBy("ty", "tx", *keys).applyInArrow(kernel, schema)


def align_file(spark, path: str, reference: DataFrame, out: str, *, method: str = "bilinear", dtype: str = "f8", **options) -> None:
    """Write the raster at ``path`` on the grid of ``reference`` (a metadata row); one that lies on it already is copied."""
    from gridloom.sources import tiff

    source, one = raster_grid(tiff.read_tiff_meta(spark, path))
    p = tiff.read_tiff(spark, path)
    if source != Grid.of(reference):
        p = warp(p, source, Grid.of(reference), method=method)
    like = reference.withColumns({"nodata": F.lit(one["nodata"]).cast("double"), "tags": F.lit(None).cast("map<string,string>")})
    tiff.write_tiff(p, like, out, bands=one["bands"], dtype=dtype, **options)


def raster_grid(metas: DataFrame):
    """(grid, row of the first file) of the files that ``tiff.write_tiff`` cut out of one raster."""
    one = metas.orderBy(F.col("y0") * F.signum("dy"), F.col("x0") * F.signum("dx")).first()
    if one["raster"]:
        return Grid(one["raster"]["height"], one["raster"]["width"], one["crs"], one["raster"]["x0"], one["raster"]["y0"], one["dx"], one["dy"]), one
    far = lambda o, d, n, a: F.max(F.round((F.col(o) - a) / F.col(d)) + F.col(n)).cast("int").alias(n)
    size = metas.agg(far("y0", "dy", "height", one["y0"]), far("x0", "dx", "width", one["x0"])).first()
    return Grid(size["height"], size["width"], *[one[c] for c in ("crs", "x0", "y0", "dx", "dy")]), one
