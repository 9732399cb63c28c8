"""Resolution pyramids: which levels there are, and their images."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.geometry import ImageMeta
from ..operators.average import averaged
from ..operators.lcc import CHUNK, Chunks, chunked
from ..operators.resample import resampled_shape

SMALLEST_EDGE = 7


@dataclass(frozen=True)
class PyramidPlan:
    """Base spacing (x, y, z), number of levels below level 0, and whether they are a factor of the square root of 2 apart."""

    spacing: tuple[float, float, float]
    levels: int
    sqrt2: bool


def plan_pyramid(images: Sequence[ImageMeta], cubic: bool = False, min_scale: float = 1.0, sqrt2: bool = False, min_voxels: int = 1000) -> PyramidPlan:
    """The base spacing is the largest of all images on each axis; levels end where an image would get too few voxels or too short an edge."""
    spacing = np.max([im.spacing for im in images], axis=0)
    if cubic:
        spacing = np.full(3, spacing.max())
    spacing = spacing * min_scale
    step = math.log(math.sqrt(2) if sqrt2 else 2.0)
    counts = []
    for im in images:
        if (spacing < np.array(im.spacing) * (1 - 1e-9)).any():
            raise ValueError("the base level would have to be finer than an image")
        voxels = im.n_voxels * float(np.prod(im.spacing)) / float(np.prod(spacing))
        counts.append(int(math.log(max(voxels / min_voxels, 1e-9)) / step / 3 + 0.5))
        counts.append(int(math.log(min(im.shape) / SMALLEST_EDGE) / step))
    return PyramidPlan(tuple(spacing.tolist()), max(0, min(counts)), sqrt2)


def level_metas(base: ImageMeta, plan: PyramidPlan) -> list[ImageMeta]:
    """Geometry of level 0 and below. With the square root of 2, level 1 comes from 0, and each further one from two above."""
    scale = np.array(plan.spacing) / np.array(base.spacing)
    metas = [base if np.allclose(scale, 1) else base.resampled(resampled_shape(base.shape, scale))]
    for i in range(1, plan.levels + 1):
        factor = math.sqrt(2) if plan.sqrt2 and i == 1 else 2.0
        parent = metas[i - 2] if plan.sqrt2 and i > 1 else metas[i - 1]
        metas.append(parent.resampled(resampled_shape(parent.shape, (factor,) * 3)))
    return metas


def build_pyramid(image: DataFrame | Chunks, base: ImageMeta, plan: PyramidPlan, mask: bool = False, keep: bool = False, edge: int = CHUNK) -> list[Chunks]:
    """All levels by chunks, the finest first; each is an exact area average of its parent. With `keep` they are kept once they have been worked out."""
    metas = level_metas(base, plan)
    held = (lambda c: replace(c, rows=c.rows.persist(StorageLevel.MEMORY_AND_DISK))) if keep else (lambda c: c)
    source = image if isinstance(image, Chunks) else held(chunked(image, base, 0, edge))
    out = [source if metas[0] == base else held(averaged(source, metas[0], mask))]
    for i in range(1, len(metas)):
        out.append(held(averaged(out[i - 2 if plan.sqrt2 and i > 1 else i - 1], metas[i], mask)))
    return out
