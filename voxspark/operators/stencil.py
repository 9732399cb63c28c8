"""Neighbourhoods: central differences and the widening of edge masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pointwise import KEY

SLOPES = ["sx", "sy", "sz"]
UNKNOWN_SLOPE = -(1 << 15)
#: (dz, dy, dx)
CROSS = [(0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
BALL = [(z, y, x) for z in range(-2, 3) for y in range(-2, 3) for x in range(-2, 3) if abs(z) + abs(y) + abs(x) <= 2]


def interior(shape: Sequence[int]) -> Column:
    nx, ny, nz = shape
    return F.col("x").between(1, nx - 2) & F.col("y").between(1, ny - 2) & F.col("z").between(1, nz - 2)


def gradient_magnitude(image: DataFrame, shape: Sequence[int], mask: DataFrame | None = None, last_z_empty: bool = False, unknown: bool = False) -> DataFrame:
    """z, y, x, v and gm, the sum of squared central differences, of interior voxels of a dense image.

    Lines of voxels are windows, so each axis costs one exchange and no join. Outside `mask` gm is 0, with `unknown`
    but for voxels whose neighbours are not all there: they keep their null. `last_z_empty` leaves out
    the last interior slice, for comparison with results made that way.
    """
    rows = image
    for axis in ("x", "y", "z"):
        line = Window.partitionBy(*[k for k in KEY if k != axis]).orderBy(axis)
        d = F.lead("v").over(line) - F.lag("v").over(line)
        rows = rows.withColumn(f"_{axis}", (d * d).cast("long"))
    rows = rows.where(interior(shape)).withColumn("gm", F.col("_x") + F.col("_y") + F.col("_z")).select(*KEY, "v", "gm")
    if last_z_empty:
        rows = rows.where(F.col("z") < shape[2] - 2)
    if mask is not None:
        rows = rows.join(mask.select(*KEY, F.col("v").alias("_m")), KEY, "left").withColumn("gm", F.when((F.coalesce("_m", F.lit(0)) != 0) | (F.col("gm").isNull() & F.lit(unknown)), F.col("gm")).otherwise(F.lit(0))).drop("_m")
    return rows


def central_differences(image: DataFrame) -> DataFrame:
    """z, y, x and the slopes sx, sy, sz: the next voxel that is there on the axis less the one before, UNKNOWN_SLOPE where either is not. Grey values have 15 bits."""
    rows = image.select(*KEY, "v")
    for axis, name in zip("xyz", SLOPES, strict=True):
        line = Window.partitionBy(*[k for k in KEY if k != axis]).orderBy(axis)
        rows = rows.withColumn(name, F.coalesce((F.lead("v").over(line) - F.lag("v").over(line)).cast("short"), F.lit(UNKNOWN_SLOPE).cast("short")))
    return rows.select(*KEY, *SLOPES)


def spread(core: DataFrame, offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """All voxels at one of the offsets from a core voxel."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in offsets]))
    return core.select(*KEY, each.alias("o")).select((F.col("z") + F.col("o.a")).alias("z"), (F.col("y") + F.col("o.b")).alias("y"), (F.col("x") + F.col("o.c")).alias("x")).distinct()


def gapless(image: DataFrame, shape: Sequence[int]) -> bool:
    """Whether the image has every voxel up to its last one, counted along x, y, z."""
    nx, ny, _ = shape
    n, last = image.agg(F.count(F.lit(1)), F.max((F.col("z").cast("long") * ny + F.col("y")) * nx + F.col("x"))).first()
    return not n or n == last + 1


def edge_mask(image: DataFrame, gradient: DataFrame, limit: float, moving: bool = False, whole: bool = True) -> DataFrame:
    """The sign-coded image: v at voxels whose gradient is above the limit, -v around them, 0 elsewhere.

    Around a fixed core lies the ball of two steps, around a moving one the cube of 5 x 5 x 5, widened axis by axis: along the
    image's own lines, or, where it is not `whole` (gapless()), across voxels that it does not have as well.
    """
    core = gradient.where(F.col("gm") > limit).select(*KEY, F.lit(1).alias("_core"))
    rows = image.select(*KEY, "v").join(core, KEY, "left")
    if moving and not whole:
        cube = core
        for axis in KEY:
            cube = cube.select(*[k for k in KEY if k != axis], F.explode(F.sequence(F.col(axis) - 2, F.col(axis) + 2)).alias(axis)).distinct()
        rows = rows.join(cube.withColumn("_ball", F.lit(1)), KEY, "left")
        near = F.col("_ball") == 1
    elif moving:
        rows = rows.withColumn("_near", F.coalesce("_core", F.lit(0)))
        for axis in ("x", "y", "z"):
            line = Window.partitionBy(*[k for k in KEY if k != axis]).orderBy(axis).rangeBetween(-2, 2)
            rows = rows.withColumn("_near", F.max("_near").over(line))
        near = F.col("_near") == 1
    else:
        rows = rows.join(spread(core, BALL).withColumn("_ball", F.lit(1)), KEY, "left")
        near = F.col("_ball") == 1
    return rows.select(*KEY, F.when(F.col("_core") == 1, F.col("v")).when(near, -F.col("v")).otherwise(0).alias("v"))
