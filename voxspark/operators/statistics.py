"""Aggregates over voxels: gradient histogram and threshold, moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pointwise import transformed
from .stencil import interior

BINS = 1 << 20


def gradient_max(gradient: DataFrame) -> int:
    return gradient.agg(F.max("gm")).first()[0] or 0


def histogram_bin(top: int, bins: int = BINS):
    scaled = F.floor(F.col("gm") / F.lit(float(max(top, 1))) * F.lit(float(bins)) + F.lit(0.5) + F.lit(2.22e-15))
    return F.least(scaled, F.lit(bins - 1)).cast("int")


def gradient_histogram(gradient: DataFrame, top: int, bins: int = BINS) -> DataFrame:
    """bin and count, of the bins that are not empty; a partial sum in every task."""
    return gradient.groupBy(histogram_bin(top, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def first_reached(counts: DataFrame, fraction: float, bits: int, digit: int = 10, zeros: int = 0) -> int | None:
    """The least bin (of `bits` bits) up to which at least that share of all counts lies, rounded half up; None without any row.
    A bin may have several rows; `zeros` more are counted in bin 0.

    Digit by digit from the highest: each round adds counts up by one digit among the bins that share the digits found so far, so
    the driver gets 2^digit rows a round at most, and nothing is sorted.
    """
    found, want = 0, None
    for low in range((bits - 1) // digit * digit, -1, -digit):
        rows = counts.where(F.shiftright(F.col("bin").cast("long"), low + digit) == found)
        counted = dict(rows.groupBy(F.shiftright(F.col("bin").cast("long"), low).alias("d")).agg(F.sum("count").alias("n")).collect())
        if zeros and not found:
            counted[0] = counted.get(0, 0) + zeros
        sums = sorted(counted.items())
        if not sums:
            return None
        if want is None:
            want = math.floor(sum(n for _, n in sums) * fraction + 0.5)
        for d, n in sums:
            if n >= want:
                found = d
                break
            want -= n
    return found


def threshold_bin(counts: DataFrame, top: int, fraction: float, bins: int = BINS, zeros: int = 0) -> tuple[int, float] | None:
    """Bin and limit: the first bin up to which all but `fraction` of the voxels lie. `counts` has columns bin and count, in any number of rows a bin.

    The fraction is held within 0 ... 1. An image without any gradient has none, and so an empty mask.
    """
    found = first_reached(counts, 1 - min(1.0, max(0.0, fraction)), (bins - 1).bit_length(), zeros=zeros) if top > 0 else None
    return None if found is None else (int(found), float(top) * found / float(bins))


def gradient_threshold(histogram: DataFrame, top: int, fraction: float, bins: int = BINS) -> DataFrame:
    """threshold_bin() as a table of one row, or of none."""
    spark, counts = histogram.sparkSession, histogram.select("bin", "count").persist(StorageLevel.MEMORY_AND_DISK)
    found = threshold_bin(counts, top, fraction, bins)
    counts.unpersist()
    return spark.createDataFrame([found] if found else [], "bin int, limit double")


def edge_fraction(fraction: float, base_surface: float, level_surface: float) -> float:
    """Of the level's voxels, so that the edges' surface is that share of the base image's."""
    return min(1.0, max(0.0, fraction * base_surface / level_surface))


def mask_stats(masked: DataFrame) -> DataFrame:
    count = lambda c, name: F.count_if(c).alias(name)
    return masked.agg(count(F.col("v") > 0, "n_core"), count(F.col("v") < 0, "n_context"), count(F.col("v") == 0, "n_background"), F.sum("v").cast("long").alias("sum_v"))


def edge_moment_sums(masked: DataFrame, shape: Sequence[int], voxel_to_world: np.ndarray) -> DataFrame:
    """Count, coordinate sums and inertia products of interior core voxels, in world coordinates."""
    p = transformed(masked.where((F.col("v") > 0) & interior(shape)), voxel_to_world)
    s = lambda e, name: F.sum(F.expr(e)).alias(name)
    return p.agg(
        F.count(F.lit(1)).alias("n"), s("px", "sx"), s("py", "sy"), s("pz", "sz"), s("py*py+pz*pz", "ixx"), s("px*px+pz*pz", "iyy"), s("px*px+py*py", "izz"),
        s("-px*py", "ixy"), s("-px*pz", "ixz"), s("-py*pz", "iyz"),
    )


def inertia(sums) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, centroid and inertia tensor about it, from a row of edge_moment_sums()."""
    if not sums.n:
        raise ValueError("the mask has no core voxel")
    c = np.array([sums.sx, sums.sy, sums.sz]) / sums.n
    t = np.array([[sums.ixx, sums.ixy, sums.ixz], [sums.ixy, sums.iyy, sums.iyz], [sums.ixz, sums.iyz, sums.izz]])
    return sums.n, c, t - sums.n * (c @ c * np.eye(3) - np.outer(c, c))


def gradient_limit(gradient: DataFrame, fraction: float) -> float:
    """The gradient above which about `fraction` of the interior voxels lie; infinite where there is no gradient. One pass over the voxels."""
    counts = gradient.groupBy("gm").agg(F.count(F.lit(1)).alias("count")).persist(StorageLevel.MEMORY_AND_DISK)
    top = gradient_max(counts)
    found = threshold_bin(counts.select(histogram_bin(top).alias("bin"), "count"), top, fraction)
    counts.unpersist()
    return found[1] if found else float("inf")
