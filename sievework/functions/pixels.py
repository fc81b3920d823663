"""Pixel grids as arrays (group L, B10, I12).

Grids are flat RGBA arrays in row order. Sums, set operations and tests are
expressions; what walks neighbours or resamples runs in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import col

NUMBERS = T.ArrayType(T.IntegerType())


def channel(rgba: Column | str, k: int) -> Column:
    return F.filter(col(rgba), lambda x, i: i % 4 == k)


def pixels(rgba: Column | str) -> Column:
    """One integer per pixel: red, green, blue, alpha from the highest byte down."""
    n = F.size(col(rgba)) / 4
    at = F.when(n >= 1, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i, k: F.get(col(rgba), i * 4 + k).cast("long")
    return F.transform(at, lambda i: byte(i, 0) * (1 << 24) + byte(i, 1) * (1 << 16) + byte(i, 2) * (1 << 8) + byte(i, 3))


def premultiply(value: Column, alpha: Column) -> Column:
    """L2: ``(value * alpha + 127) div 255`` in integers."""
    return F.floor((value * alpha + 127) / 255).cast("int")


def unpremultiply(value: Column, alpha: Column) -> Column:
    return F.when(alpha == 0, 0).otherwise(F.least(F.lit(255), F.floor((value * 255 + F.floor(alpha / 2)) / alpha))).cast("int")


def alpha_class(rgba: Column | str) -> Column:
    """Opaque, binary or continuous."""
    a = channel(rgba, 3)
    return F.when(F.forall(a, lambda x: x == 255), "opaque").when(F.forall(a, lambda x: x.isin(0, 255)), "binary").otherwise("continuous")


def unique_colors(rgba: Column | str) -> Column:
    """Distinct colours of visible pixels."""
    return F.size(F.array_distinct(F.filter(pixels(rgba), lambda p: p % 256 > 0)))


def canonical(rgba: Column | str) -> Column:
    """Colours under zero alpha count as black."""
    return F.transform(col(rgba), lambda x, i: F.when(F.get(col(rgba), (i - i % 4 + 3).cast("int")) == 0, 0).otherwise(x))


def grid_hash(rgba: Column | str, height: Column | str, width: Column | str) -> Column:
    """SHA-256 of the shape and the canonical bytes."""
    return F.sha2(F.concat_ws("x", col(height), col(width), F.array_join(canonical(rgba), ",")), 256)


def mean_abs_error(a: Column | str, b: Column | str) -> Column:
    """L14."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(col(a))


def alpha_iou(a: Column | str, b: Column | str) -> Column:
    """Overlap of visible pixels; an empty union counts as 1."""
    both = F.zip_with(channel(a, 3), channel(b, 3), lambda x, y: F.when((x > 0) & (y > 0), 2).when((x > 0) | (y > 0), 1).otherwise(0))
    union = F.size(F.filter(both, lambda x: x > 0))
    return F.when(union == 0, 1.0).otherwise(F.size(F.filter(both, lambda x: x == 2)) / union)


def _grids(flat, h, w) -> list[np.ndarray]:
    return [np.asarray(x, np.int64).reshape(a, b, 4) for x, a, b in zip(flat, h, w, strict=True)]


@F.pandas_udf(NUMBERS)
def lossless_cell(flat: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """L3: height and width of the smallest grid that, with each pixel repeated, gives the same picture."""

    def smallest(g):
        for k in range(min(g.shape[:2]), 1, -1):
            if g.shape[0] % k == 0 and g.shape[1] % k == 0:
                small = g[::k, ::k]
                if (np.repeat(np.repeat(small, k, 0), k, 1) == g).all():
                    return [*small.shape[:2]]
        return [*g.shape[:2]]

    return pd.Series([smallest(g) for g in _grids(flat, h, w)])


@F.pandas_udf(NUMBERS)
def quantize(flat: pd.Series, palette: pd.Series) -> pd.Series:
    """Each pixel takes the nearest palette colour, alpha kept; ties by palette order."""

    def near(x, p):
        g, colors = np.asarray(x, np.int64).reshape(-1, 4), np.asarray(p, np.int64).reshape(-1, 3)
        best = ((g[:, None, :3] - colors[None]) ** 2).sum(-1).argmin(1)
        return np.concatenate([colors[best], g[:, 3:]], 1).reshape(-1).tolist()

    return pd.Series([near(x, p) for x, p in zip(flat, palette, strict=True)])


@F.pandas_udf(NUMBERS)
def roll(flat: pd.Series, h: pd.Series, w: pd.Series, dy: pd.Series, dx: pd.Series) -> pd.Series:
    """The grid shifted with wrap-around."""
    return pd.Series([np.roll(g, (int(y), int(x)), (0, 1)).reshape(-1).tolist() for g, y, x in zip(_grids(flat, h, w), dy, dx, strict=True)])
