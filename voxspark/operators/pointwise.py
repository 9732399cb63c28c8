"""Operators that look at one voxel, or at the same voxel of two images. A voxel table has z, y, x and v."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUND = 2.22e-15  #: added before truncation, so that a half that was lost to rounding goes up
AXES = ("x", "y", "z")
KEY = ["z", "y", "x"]


def rounded(x: Column) -> Column:
    """Half up, for values from 0."""
    return F.floor(x + F.lit(0.5) + F.lit(ROUND))


def value_range(image: DataFrame, value: str = "v") -> DataFrame:
    return image.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


def rescale(image: DataFrame, low: float, high: float, bits: int, value: str = "v") -> DataFrame:
    """Grey values to 1 ... 2^bits - 1; 0 is left for the background. A constant image becomes 1; values that are not known stay so, as in an image without any (`low` and `high` None)."""
    if low is None:
        return image.withColumn("v", F.lit(None).cast("int"))
    top = (1 << bits) - 1
    g = F.col(value).cast("double")
    inner = rounded((g - F.lit(low)) / F.lit(high - low if high > low else 1.0) * F.lit(float(top - 1)) + F.lit(1))
    return image.withColumn("v", F.when(g <= low, 1).when(g >= high, top).otherwise(inner).cast("int"))


def binarize(image: DataFrame) -> DataFrame:
    return image.withColumn("v", (F.col("v") != 0).cast("int"))


def magnitude(image: DataFrame) -> DataFrame:
    return image.withColumn("v", F.abs("v"))


def difference(a: DataFrame, b: DataFrame, absolute: bool = False, wrap_bits: int | None = None) -> DataFrame:
    """a - b where both have the voxel. `wrap_bits` gives what unsigned integers of that width would hold."""
    d = F.col("v") - F.col("w")
    if wrap_bits:
        d = F.pmod(d, F.lit(1 << wrap_bits))
    elif absolute:
        d = F.abs(d)
    return a.join(b.select(*KEY, F.col("v").alias("w")), KEY).select(*KEY, d.alias("v"))


def crop(image: DataFrame, offset: Sequence[int], size: Sequence[int]) -> DataFrame:
    """The box that begins at `offset` (x, y, z), with coordinates from its corner."""
    box = image
    for k, o, n in zip(AXES, offset, size, strict=True):
        box = box.where(F.col(k).between(o, o + n - 1))
    return box.withColumns({k: F.col(k) - o for k, o in zip(AXES, offset, strict=True)})


def strided(image: DataFrame, skip: Sequence[int]) -> DataFrame:
    """Every skip-th voxel of each axis (x, y, z)."""
    kept = image
    for k, s in zip(AXES, skip, strict=True):
        kept = kept.where(F.col(k) % s == 0)
    return kept.withColumns({k: (F.col(k) / s).cast("int") for k, s in zip(AXES, skip, strict=True)})


def affine(matrix: np.ndarray, source: Sequence[str] = AXES) -> list[Column]:
    """The three coordinates that the upper rows of a 4 x 4 matrix give."""
    rows = []
    for r in np.asarray(matrix, float)[:3]:
        rows.append(F.lit(float(r[0])) * F.col(source[0]) + F.lit(float(r[1])) * F.col(source[1]) + F.lit(float(r[2])) * F.col(source[2]) + F.lit(float(r[3])))
    return rows


def transformed(points: DataFrame, matrix: np.ndarray, source: Sequence[str] = AXES, to: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    return points.withColumns(dict(zip(to, affine(matrix, source), strict=True)))


def inside(shape: Sequence[int], margin: float, point: Sequence[str] = ("px", "py", "pz")) -> Column:
    """margin <= p < n - 1 - margin on every axis (x, y, z): -0.5 for the whole image, 0.5 for one voxel less."""
    out = F.lit(True)
    for k, n in zip(point, shape, strict=True):
        out = out & (F.col(k) >= margin) & (F.col(k) < n - 1 - margin)
    return out


def array_text(column: Column) -> Column:
    return F.array_join(column.cast("array<string>"), " ")


def text_array(column: Column) -> Column:
    return F.array_remove(F.split(F.trim(column), r"\s+"), "").cast("array<double>")
