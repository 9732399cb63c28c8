"""Area averages and interpolation as joins and weighted sums; resampling by chunks, which moves blocks instead of eight rows a voxel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ImageMeta
from .pointwise import AXES, KEY, ROUND, inside, rounded, transformed
from .tiles import BOX_VOXELS, TILE, assembled, boxed, linear_values, mirrored_values, pair_bound, planned, transformed_points


def downsample(image: DataFrame, shape: Sequence[int], to: Sequence[int], mask: bool = False) -> DataFrame:
    """Exact area average to the size `to` (x, y, z), rounded half up; a mask is 1 where more than a quarter is.

    Overlaps are integers: input i of n meets output k of m in min((k+1)n, (i+1)m) - max(kn, im) parts of nm, so the sums
    are exact in any order. One exchange, after partial sums in every task.
    """
    if any(m > n or m < 1 for n, m in zip(shape, to, strict=True)):
        raise ValueError(f"cannot average {tuple(shape)} to {tuple(to)}")
    rows, weight = image, F.lit(1).cast("long")
    for k, n, m in zip(AXES, shape, to, strict=True):
        i = F.col(k).cast("long")
        rows = rows.withColumn(f"_{k}", F.explode(F.sequence(F.floor(i * m / F.lit(n)), F.floor(((i + 1) * m - 1) / F.lit(n)))))
        o = F.col(f"_{k}")
        weight = weight * (F.least((o + 1) * n, (i + 1) * m) - F.greatest(o * n, i * m))
    total = rows.groupBy(*[F.col(f"_{k}").cast("int").alias(k) for k in KEY]).agg(F.sum(weight * F.col("v")).alias("_sum"))
    den = int(np.prod(shape))
    value = (F.col("_sum") * 4 > den).cast("int") if mask else F.expr(f"cast((2 * _sum + {den}) div {2 * den} as int)")
    return total.select(*KEY, value.alias("v"))


def resampled_shape(shape: Sequence[int], scale: Sequence[float]) -> tuple[int, ...]:
    return tuple(max(1, round(n / s)) for n, s in zip(shape, scale, strict=True))


def corners(points: DataFrame) -> DataFrame:
    """Eight rows a point (px, py, pz): the lattice corner cx, cy, cz around it and its weight."""
    rows = points.withColumns({f"_f{k}": F.floor(F.col(f"p{k}")).cast("int") for k in AXES})
    each = F.explode(F.array(*[F.struct(*[F.lit((i >> j) & 1).alias(k) for j, k in enumerate(AXES)]) for i in range(8)]))
    rows = rows.withColumn("_o", each).withColumns({f"c{k}": F.col(f"_f{k}") + F.col(f"_o.{k}") for k in AXES})
    w = F.lit(1.0)
    for k in AXES:
        d = F.col(f"p{k}") - F.col(f"_f{k}")
        w = w * F.when(F.col(f"_o.{k}") == 1, d).otherwise(1 - d)
    return rows.withColumn("w", w).drop("_o", *[f"_f{k}" for k in AXES])


def _corner_values(points: DataFrame, image: DataFrame) -> DataFrame:
    at = image.select(*[F.col(k).alias(f"c{k}") for k in AXES], F.col("v").alias("g"))
    return corners(points).join(at, [f"c{k}" for k in AXES])


def interpolate_masked(points: DataFrame, image: DataFrame, shape: Sequence[int], by: Sequence[str]) -> DataFrame:
    """`by` and t: trilinear magnitude of a sign-coded image, positive if a corner is core, else negative.

    Points within one voxel of the border have no value, nor have those with a background corner, whatever
    its weight; they give no row.
    """
    rows = _corner_values(points.where(inside(shape, 0.5)), image.where("v <> 0"))
    t = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("w") * F.abs("g")).alias("_t"), F.max("g").alias("_g")).where("_n = 8")
    return t.select(*by, F.when(F.col("_g") > 0, F.col("_t")).otherwise(-F.col("_t")).alias("t"))


def _mirrored(c: Column, n: int) -> Column:
    return F.when(c < 0, 1).when(c >= n, n - 2).otherwise(c)


def interpolate_mirrored(points: DataFrame, image: DataFrame, shape: Sequence[int], by: Sequence[str]) -> DataFrame:
    """`by` and t: trilinear value inside the image's outer faces, mirrored at the outermost voxels; no row outside."""
    rows = corners(points.where(inside(shape, -0.5)))
    rows = rows.withColumns({f"c{k}": _mirrored(F.col(f"c{k}"), n) for k, n in zip(AXES, shape, strict=True)})
    at = image.select(*[F.col(k).alias(f"c{k}") for k in AXES], F.col("v").alias("g"))
    return rows.join(at, [f"c{k}" for k in AXES]).groupBy(*by).agg(F.sum(F.col("w") * F.col("g")).alias("t"))


def transform_block(grid: DataFrame, image: DataFrame, shape: Sequence[int], matrix: np.ndarray, mask: bool = False) -> DataFrame:
    """The image at the transformed voxels of `grid`, rounded, 0 outside; a mask is 1 above 0.4."""
    points = transformed(grid.select(*KEY), matrix)
    t = interpolate_mirrored(points, image, shape, KEY)
    value = (F.col("t") > 0.4).cast("int") if mask else rounded(F.col("t")).cast("int")
    return grid.select(*KEY).join(t, KEY, "left").select(*KEY, F.coalesce(value, F.lit(0)).alias("v"))


def resample_linear(grid: DataFrame, image: DataFrame, shape: Sequence[int], matrix: np.ndarray, limits: tuple[int, int] | None = (-(1 << 31), (1 << 31) - 1)) -> DataFrame:
    """Trilinear without mirroring: 0 outside the outermost voxel centres; rounded half up and held within `limits`, or as it is without any."""
    points = transformed(grid.select(*KEY), matrix)
    within = F.lit(True)
    for k, n in zip(AXES, shape, strict=True):
        within = within & F.col(f"p{k}").between(0, n - 1)
    t = _corner_values(points.where(within), image).where("w > 0").groupBy(*KEY).agg(F.sum(F.col("w") * F.col("g")).alias("t"))
    value = F.coalesce("t", F.lit(0.0))
    if limits is not None:
        value = F.least(F.greatest(rounded(F.coalesce("t", F.lit(0.0))), F.lit(limits[0])), F.lit(limits[1]))
        value = value.cast("int") if -(1 << 31) <= limits[0] and limits[1] < 1 << 31 else value.cast("long")
    return grid.select(*KEY).join(t, KEY, "left").select(*KEY, value.alias("v"))


# --- by chunks ------------------------------------------------------------------------------------


def grid_places(spark, shape: Sequence[int], edge: int) -> DataFrame:
    """cz, cy and cx of all chunks of a grid."""
    nx, ny, nz = (-(-n // edge) for n in shape)
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i / (nx * ny)).cast("long").alias("cz"), (i / nx % ny).cast("long").alias("cy"), (i % nx).alias("cx"))


def regridded(grid, image, matrix: np.ndarray, values: Callable, kind: str, most: int = BOX_VOXELS) -> DataFrame:
    """z, y, x and v of every voxel of `grid`: values(box, first, points, shape) of the voxels' places under `matrix`, from an image by chunks without a rim.

    A grid is a geometry, for all its voxels, or an image by chunks without a rim, for those of its voxels that are there and not 0.

    Tiles of the grid meet the image's chunks by arithmetic (tiles.py), and what of a chunk a tile needs is exchanged once. A task
    holds a tile and its box, of at most `most` voxels under any transform.
    """
    edge, shape = image.edge, image.meta.shape
    own, voxels = (grid, None) if isinstance(grid, ImageMeta) else (grid.meta, grid)
    if voxels is not None and (voxels.halo or voxels.edge != edge):
        raise ValueError("grid and image need chunks of one size without a rim")
    places = grid_places(image.rows.sparkSession, own.shape, edge)
    plan = lambda rows, *block: planned(rows, edge, own.shape, [matrix], shape, 0, 1, most, *block, empty=True)
    tiles = plan(places)
    cut = None if voxels is None else voxels.kind
    number = {"int": np.int32, "long": np.int64, "double": np.float64}[kind]
    source, none = image.kind, np.zeros(0, np.int32)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"z": none, "y": none, "x": none, "v": none.astype(number)})
        r = left.iloc[0]
        z, y, x = (a.ravel() + o for a, o in zip(np.indices((r.nz, r.ny, r.nx)), (r.z0, r.y0, r.x0), strict=True))
        if cut is not None:
            some = np.frombuffer(r.block, cut) != 0
            z, y, x = z[some], y[some], x[some]
        v = np.zeros(len(z), number)
        if len(right):
            first, box = assembled(right, source)
            v = values(box, first, transformed_points(matrix, x, y, z), shape).astype(number)
        return pd.DataFrame({"z": z.astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": v})

    parts = boxed(tiles, image.rows, edge, source, pair_bound(edge, own.shape, [matrix], shape, 0, 1, most))
    asked = tiles if voxels is None else plan(voxels.rows, 0, voxels.kind)
    return asked.groupBy(*TILE).cogroup(parts.groupBy(*TILE)).applyInPandas(work, f"z int, y int, x int, v {kind}")


def transform_chunks(grid, image, matrix: np.ndarray, mask: bool = False, most: int = BOX_VOXELS) -> DataFrame:
    """As transform_block(), from an image by chunks: mirrored at the outermost voxels, rounded, 0 outside; a mask is 1 above 0.4."""

    def values(*given) -> np.ndarray:
        t = mirrored_values(*given)
        return np.nan_to_num(t) > 0.4 if mask else np.floor(np.nan_to_num(t) + 0.5 + ROUND)

    return regridded(grid, image, matrix, values, "int", most)


def linear_chunks(grid, image, matrix: np.ndarray, limits: tuple[int, int] | None = (-(1 << 31), (1 << 31) - 1), most: int = BOX_VOXELS) -> DataFrame:
    """As resample_linear(), from an image by chunks: 0 outside the outermost voxel centres; rounded half up and held within `limits`, or as it is without any."""

    def values(*given) -> np.ndarray:
        t = np.nan_to_num(linear_values(*given))
        return t if limits is None else np.clip(np.floor(t + 0.5 + ROUND), *limits)

    kind = "double" if limits is None else "int" if -(1 << 31) <= limits[0] and limits[1] < 1 << 31 else "long"
    return regridded(grid, image, matrix, values, kind, most)
