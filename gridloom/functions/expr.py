"""Column expressions: all are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_text(value: Column) -> Column:
    """12.5 -> '12.50%'."""
    return F.format_string("%.2f%%", value)


def patch_name(i: Column) -> Column:
    """7 -> 'patch_00007'."""
    return F.format_string("patch_%05d", i)


def stable_order(key: Column) -> Column:
    """A portable pseudo-random order of a stable key."""
    return F.md5(key.cast("string"))


def cloud_bits(c: Column) -> dict[str, Column]:
    """The two readings of a cloud mask: opaque and cirrus bits (10, 11), and bit 3 of 8-bit masks."""
    c = c.cast("int")
    return {
        "opaque": F.shiftright(c, 10).bitwiseAND(F.lit(1)) == 1,
        "cirrus": F.shiftright(c, 11).bitwiseAND(F.lit(1)) == 1,
        "cloud8": c.bitwiseAND(F.lit(8)) != 0,
    }


def finite_or(v: Column, default: float = 0.0) -> Column:
    """NaN, infinities and nulls become ``default``."""
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def clip(v: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, v))


def fold_edge(i: Column, n: Column | int) -> Column:
    """Index reflected with the edge repeated: -1 -> 0, n -> n - 1 (one bounce)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)


def fold_inner(i: Column, n: Column | int) -> Column:
    """Index reflected without repeating the edge: n -> n - 2 (one bounce)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def clamp_index(i: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.greatest(F.lit(0), F.least(i, n - 1))


def radial_weight(dy: Column, dx: Column, size: int) -> Column:
    """clip(1 - r, 0.2, 1); r from the patch centre, coordinates spread evenly over [-1, 1]."""
    step = 2e0 / (size - 1)
    a, b = dy * F.lit(step) - 1, dx * F.lit(step) - 1
    return clip(1 - F.sqrt(a * a + b * b), 0.2, 1.0)


def soft_weight(dy: Column, dx: Column, size: int) -> Column:
    """clip(1 - r / 2, 0.4, 1); r in units of half a patch from pixel size / 2."""
    half = size / 2
    a, b = (dy - half) / half, (dx - half) / half
    return clip(1 - F.sqrt(a * a + b * b) * 0.5, 0.4, 1.0)


def overlap_of(receptive_field: Column, patch: Column) -> Column:
    """Half the receptive field; a quarter of the patch where that reaches half of it."""
    half = F.floor(receptive_field / 2)
    return F.when(half >= patch / 2, F.floor(patch / 4)).otherwise(half).cast("int")
