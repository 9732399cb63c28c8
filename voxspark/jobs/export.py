"""Results for other programs: transform matrix, validation table, run record."""

from __future__ import annotations

import json

import numpy as np

from ..functions.geometry import ImageMeta, euler_degrees, swap_handedness, transform_points
from ..sources import mhd
from .register import Registration

RULE = "-" * 73


def matrix_text(matrix: np.ndarray, ras: bool = False) -> str:
    m = swap_handedness(matrix) if ras else matrix
    return "\n".join(" ".join(repr(float(x)) for x in row) for row in m) + "\n"


def read_matrix(text: str) -> np.ndarray:
    m = np.array([[float(x) for x in line.split()] for line in text.splitlines() if line.strip()])
    if m.shape != (4, 4):
        raise ValueError("a transform has four rows of four numbers")
    return m


def validation_rows(fixed: ImageMeta, matrix: np.ndarray) -> list[tuple]:
    """Number, place and transformed place of the fixed image's eight corners."""
    at = fixed.corners()
    return [(i + 1, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(at, transform_points(matrix, at), strict=True))]


def validation_text(fixed: ImageMeta, matrix: np.ndarray, header: str = "") -> str:
    rows = "".join(f"{r[0]:3d}  " + "".join(f"{x:11.4f}" for x in r[1:]) + "\n" for r in validation_rows(fixed, matrix))
    return f"{header}\n\n{rows}\n(All distances are in millimeters.)\n{RULE}\n"


def moved_header(path: str, matrix: np.ndarray) -> str:
    """The header of a moving image under a rigid transform: voxels stay where they are, named by their full path, and only their place changes."""
    header = mhd.read_header(path)
    own = mhd.header_of(mhd.meta_of(header).moved(matrix), mhd.payload_path(path, header), header["ElementType"])
    return mhd.format_header({**header, **{k: own[k] for k in ("Offset", "TransformMatrix", "ElementDataFile")}})


def run_record(result: Registration) -> str:
    levels = [{"lcc": o.lcc, "p": list(map(float, o.p)), "steps": o.steps} for o in result.levels]
    return json.dumps({"lcc": result.lcc, "p": list(map(float, result.p)), "matrix": result.matrix.tolist(), "euler_degrees": euler_degrees(result.matrix).tolist(), "levels": levels})
