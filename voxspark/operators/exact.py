"""Sums of floating-point numbers that do not depend on their order: numbers cut into integer limbs, which Spark adds up."""

from __future__ import annotations

import numpy as np

LIMBS = 12
LOW = 160  #: limbs begin at 2^-LOW; what lies below is cut off


def to_limbs(values: np.ndarray) -> np.ndarray:
    """int64, a row of LIMBS for each finite number below 2^220: its bits in units of 2^(32 i - LOW), all of its sign."""
    x = np.asarray(values, float).ravel()
    if not np.isfinite(x).all() or (np.abs(x) >= 2.0**220).any():
        raise OverflowError("a number is out of range")
    part, power = np.frexp(np.abs(x))
    whole, at = (part * 2.0**53).astype(np.uint64), power.astype(np.int64) - 53 + LOW
    below = np.minimum(np.maximum(-at, 0), 63)
    whole, at = whole >> below.astype(np.uint64), np.maximum(at, 0)
    first, shift = at // 32, (at % 32).astype(np.uint64)
    half, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
    low, high = (whole & mask) << shift, (whole >> half) << shift
    row, sign = np.arange(len(x)), np.where(x < 0, -1, 1)
    out = np.zeros((len(x), LIMBS), np.int64)
    for k, part in enumerate((low & mask, (low >> half) + (high & mask), high >> half)):
        out[row, np.minimum(first + k, LIMBS - 1)] += sign * part.astype(np.int64)
    return out


def from_limbs(limbs) -> float:
    """The sum, rounded once."""
    return sum(int(v) << 32 * i for i, v in enumerate(limbs)) / (1 << LOW)
