"""Edge masking of an image: gradient, histogram, threshold, sign-coded mask."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.geometry import ImageMeta
from ..operators.statistics import gradient_limit as threshold
from ..operators.stencil import edge_mask, gapless, gradient_magnitude


def mask_image(image: DataFrame, meta: ImageMeta, fraction: float, moving: bool, mask: DataFrame | None = None) -> DataFrame:
    gradient = gradient_magnitude(image, meta.shape, mask, unknown=True)
    return edge_mask(image, gradient, threshold(gradient, fraction), moving, not moving or gapless(image, meta.shape))
