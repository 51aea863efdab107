"""Arithmetic on row-major pixel arrays, as array expressions; only edges need numpy.

Everything is an integer until a last division, so that results are exact. Pixels are bound
before they are used inside a lambda, or Spark would derive them again for each row of a frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def span(n: Column) -> Column:
    """0 .. n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def gray(blue: Column, green: Column, red: Column) -> Column:
    """Fixed-point luma of 8-bit channels."""
    return F.shiftright(blue * 3735 + green * 19235 + red * 9798 + 16384, 15)


def changed(a: Column, b: Column, threshold: int) -> Column:
    """Number of places whose values differ by more than the threshold."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > threshold)).cast("long")


def crop(pixels: Column, width: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The rectangle at (x, y)."""
    rows = lambda px: F.transform(span(h), lambda r: F.slice(px, ((y + r) * width + x + 1).cast("int"), w.cast("int")))
    return F.flatten(_bound(pixels, rows))


def row_sums(pixels: Column, width: Column, height: Column) -> Column:
    return _bound(pixels, lambda px: F.transform(span(height), lambda r: _sum(F.slice(px, (r * width + 1).cast("int"), width.cast("int")))))


def column_sums(pixels: Column, width: Column, height: Column) -> Column:
    """Rows are added as wholes."""
    none = F.array_repeat(F.lit(0).cast("long"), F.greatest(width, F.lit(0)).cast("int"))
    row = lambda px, r: F.slice(px, (r * width + 1).cast("int"), width.cast("int"))
    return _bound(pixels, lambda px: F.aggregate(span(height), none, lambda sums, r: F.zip_with(sums, row(px, r), lambda a, v: a + v)))


def leading_dark(sums: Column, length: Column, limit: int, across: Column) -> Column:
    """How many leading lines have a mean of at most ``limit``, looking at so many lines."""
    bright = F.filter(span(length), lambda i: F.get(sums, i) > across * limit)
    return F.coalesce(F.get(bright, 0), length).cast("long")


def border(pixels: Column, width: Column, height: Column, limit: int = 10) -> Column:
    """struct<top, bottom, left, right>: dark lines from each side, up to the middle; bottom and right stop one line earlier."""
    half_h, half_w = F.floor(height / 2), F.floor(width / 2)

    def sides(s: Column) -> Column:
        rows, columns = s["rows"], s["columns"]
        return F.struct(
            leading_dark(rows, half_h, limit, width).alias("top"),
            leading_dark(F.reverse(rows), height - 1 - half_h, limit, width).alias("bottom"),
            leading_dark(columns, half_w, limit, height).alias("left"),
            leading_dark(F.reverse(columns), width - 1 - half_w, limit, height).alias("right"),
        )

    sums = lambda px: F.struct(row_sums(px, width, height).alias("rows"), column_sums(px, width, height).alias("columns"))
    return _bound(pixels, lambda px: _bound(sums(px), sides))


def spread(pixels: Column) -> Column:
    """n * sum of squares - square of the sum: the variance times n squared."""
    squares = lambda px: F.aggregate(px, F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)
    return _bound(pixels, lambda px: _bound(_sum(px), lambda total: F.size(px) * squares(px) - total * total))


def edges(pixels: Column, width: Column, height: Column, limit: int = 30) -> Column:
    """Pixels whose 3 x 3 Sobel magnitude exceeds the limit; borders mirror without repeating the edge.

    Nine neighbours of each pixel are beyond what array expressions do in good time (some ten
    microseconds a pixel), so frames go to numpy as Arrow batches. Null pixels or sizes give null, no pixels 0.
    """

    def strong(px: np.ndarray, w: int, h: int) -> int:
        if w < 1 or h < 1:
            return 0
        p = np.pad(np.asarray(px, dtype=np.int64)[: w * h].reshape(h, w), 1, mode="reflect")
        sums, steps = p[:-2] + 2 * p[1:-1] + p[2:], p[2:] - p[:-2]
        gx, gy = sums[:, 2:] - sums[:, :-2], steps[:, :-2] + 2 * steps[:, 1:-1] + steps[:, 2:]
        return int((gx * gx + gy * gy > limit * limit).sum())

    @F.pandas_udf("long")
    def counted(px: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or pd.isna(a) or pd.isna(b) else strong(p, int(a), int(b)) for p, a, b in zip(px, w, h, strict=True)], dtype="Int64")

    return counted(pixels, width, height)
