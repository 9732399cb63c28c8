"""Registration from a typed configuration: pyramid, masks, coarse-to-fine optimisation."""

from __future__ import annotations

import configparser
import contextlib
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..functions.geometry import ImageMeta, matrix_from_p, p_from_matrix, swap_handedness
from ..operators.blocks import masked_chunks
from ..operators.lcc import Chunks, Overlap
from ..operators.statistics import edge_fraction
from .optimise import Outcome, levenberg_marquardt, simple_gradient, transform_from_moments
from .pyramid import PyramidPlan, build_pyramid, level_metas, plan_pyramid

Image = DataFrame | Chunks | list[Chunks]


@dataclass(frozen=True)
class Config:
    affine: bool = False
    fixed_fraction: float = 0.1
    moving_fraction: float = 0.1
    cubic: bool = False
    min_scale: float = 1.0
    sqrt2: bool = False
    min_voxels: int = 1000
    moments: bool = False
    shift_only: bool = False
    simple_gradient: bool = True
    step_first: float = 2.0
    step_least: float = 0.25
    damping: float = 0.1
    damping_up: float = 5.0
    damping_down: float = 0.2
    most_steps: int = 50
    most_up: int = 4
    min_shift: float = 0.01
    inverted: bool = False
    ras: bool = False


#: (section, key) of the configuration file for each field.
KEYS: Mapping[str, tuple[str, str]] = {
    "fixed_fraction": ("masking", "fixed_used_gradient_magnitude_fraction"),
    "moving_fraction": ("masking", "moving_used_gradient_magnitude_fraction"),
    "cubic": ("multiresolution", "pyramid_cubic_voxels"),
    "min_scale": ("multiresolution", "pyramid_min_scale_factor"),
    "sqrt2": ("multiresolution", "pyramid_sqrt2_scaling"),
    "min_voxels": ("multiresolution", "pyramid_min_voxel_nr"),
    "moments": ("transformation", "initialise_from_edge_moments"),
    "shift_only": ("transformation", "initialise_shift_only"),
    "inverted": ("transformation", "initial_transform_is_inverted"),
    "ras": ("transformation", "initial_transform_is_RAS"),
    "simple_gradient": ("simple_gradient", "active"),
    "step_first": ("simple_gradient", "delta_v_initial"),
    "step_least": ("simple_gradient", "delta_v_min"),
    "damping": ("levenberg_marquardt", "initial_lambda"),
    "damping_up": ("levenberg_marquardt", "lambda_upscale_factor"),
    "damping_down": ("levenberg_marquardt", "lambda_downscale_factor"),
    "most_steps": ("levenberg_marquardt", "max_nr_of_iterations"),
    "most_up": ("levenberg_marquardt", "max_nr_of_upscale_steps"),
    "min_shift": ("levenberg_marquardt", "min_edge_voxel_displacement"),
}


def read_config(text: str) -> Config:
    """Typed values from an INI text with ${section:key} references; nothing in it is executed."""
    ini = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation())
    ini.read_string(text)
    known, found = Config(), {}
    for name, (section, key) in KEYS.items():
        if ini.has_option(section, key):
            kind = type(getattr(known, name))
            read = {bool: ini.getboolean, int: ini.getint, float: ini.getfloat}[kind]
            found[name] = read(section, key)
    found["affine"] = ini.get("transformation", "transformation_type", fallback="rigid").strip().lower() == "affine"
    return replace(known, **found)


def initial_matrix(matrix: np.ndarray | None, config: Config) -> np.ndarray:
    """The given 4 x 4 transform as the optimiser wants it; identity without one. File and moments exclude each other."""
    if matrix is None:
        return np.eye(4)
    if config.moments:
        raise ValueError("an initial transform and moments cannot both be given")
    m = swap_handedness(matrix) if config.ras else np.asarray(matrix, float)
    return np.linalg.inv(m) if config.inverted else m


@dataclass(frozen=True)
class Registration:
    p: np.ndarray
    matrix: np.ndarray
    lcc: float
    levels: list[Outcome] = field(default_factory=list)


def same_geometry(image: ImageMeta, mask: ImageMeta, role: str) -> None:
    """A mask has its image's size, spacing, offset and directions."""
    if tuple(image.shape) != tuple(mask.shape) or not all(np.allclose(getattr(image, k), getattr(mask, k)) for k in ("spacing", "offset", "direction")):
        raise ValueError(f"geometry of {role} mask and image differ")


def pyramid_plan(f: ImageMeta, m: ImageMeta, config: Config) -> PyramidPlan:
    return plan_pyramid([f, m], config.cubic, config.min_scale, config.sqrt2, config.min_voxels)


class _Levels:
    """One image's pyramid by chunks, each level kept as soon as it is used, so that none is worked out twice. Stored levels are taken as they are."""

    def __init__(self, image: Image, meta: ImageMeta, plan, mask: Image | None, fraction: float, moving: bool):
        self.images, self.own = self._levels(image, meta, plan, False)
        self.masks, more = self._levels(mask, meta, plan, True) if mask is not None else (None, [])
        self.own += more
        self.meta, self.fraction, self.moving = meta, fraction, moving

    @staticmethod
    def _levels(image: Image, meta: ImageMeta, plan, mask: bool) -> tuple[list[Chunks], list[Chunks]]:
        if isinstance(image, list):
            if [c.meta.shape for c in image] != [m.shape for m in level_metas(meta, plan)]:
                raise ValueError("the stored levels are not those of the plan")
            return image, []
        made = build_pyramid(image, meta, plan, mask, keep=True)
        return made, [c for c in made if c is not image]

    def chunks(self, i: int) -> Chunks:
        """The edge-masked level; the fraction is of the base image's surface, so that it grows on coarse levels."""
        level = self.images[i]
        own = edge_fraction(self.fraction, self.meta.voxel_surface, level.meta.voxel_surface)
        return masked_chunks(level, level.meta, own, self.moving, self.masks[i] if self.masks else None)

    def close(self) -> None:
        for c in self.own:
            c.rows.unpersist()


def register(fixed: Image, f: ImageMeta, moving: Image, m: ImageMeta, config: Config = Config(), matrix: np.ndarray | None = None,
             fixed_mask: tuple[ImageMeta, Image] | None = None, moving_mask: tuple[ImageMeta, Image] | None = None, states: States | None = None) -> Registration:
    """Coarse to fine: levels, masks and chunks are made once and used by every evaluation there.

    An image is a table of voxels, chunks without a rim, or the stored levels of its pyramid, the finest first.
    A mask (its geometry, and voxels of 0 and 1) restricts an image's edges to where it is not 0; a voxel
    of a coarser mask is 1 where more than a quarter of it is. Moments are taken on the middle level.
    With `states`, every finished level is noted there, and a run goes on after the last one that is.
    """
    for meta in (f, m):
        if min(meta.shape) < 6:
            raise ValueError("an image needs six voxels or more on each axis")
    for role, meta, mask in (("fixed", f, fixed_mask), ("moving", m, moving_mask)):
        if mask is not None:
            same_geometry(meta, mask[0], role)
    plan = pyramid_plan(f, m, config)
    fl = _Levels(fixed, f, plan, fixed_mask and fixed_mask[1], config.fixed_fraction, False)
    ml = _Levels(moving, m, plan, moving_mask and moving_mask[1], config.moving_fraction, True)
    p, centre, axes = p_from_matrix(initial_matrix(matrix, config), config.affine), None, None
    known = dict(states.reached()) if states else {}
    done, last = [known[i] for i in sorted(known, reverse=True) if i >= 0], len(fl.images) - 1

    def note(level: int, outcome: Outcome) -> Outcome:
        if states:
            states.add(last - level if level >= 0 else -1, level, outcome)
        return outcome

    try:
        if config.moments:
            start = known.get(-1)
            if start is None:
                with _both(fl, ml, len(fl.images) // 2) as (fc, mc):
                    start = note(-1, transform_from_moments(fc, mc, config.shift_only))
            p, centre, axes = p_from_matrix(matrix_from_p(start.p), config.affine), start.centre, start.axes
        if done:
            p = done[-1].p
        for i in range(last - len(done), -1, -1):
            with _both(fl, ml, i) as (fc, mc), Overlap(fc, mc) as overlap:
                if i == last and config.simple_gradient and not config.affine:
                    p = simple_gradient(overlap, p, centre, axes, config.step_first, config.step_least).p
                got = levenberg_marquardt(overlap, p, config.damping, config.damping_up, config.damping_down, config.most_steps, config.most_up, config.min_shift)
            p = got.p
            done.append(note(i, got))
    finally:
        fl.close()
        ml.close()
    return Registration(p, matrix_from_p(p), done[-1].lcc, done)


class States:
    """What a run has reached: a table of level, p, lcc and steps to which each finished step is appended; the driver may be lost at any time.

    A step's rows are there in whole or not at all, as Spark commits them. `name` stands for everything that the run depends on.
    """

    SCHEMA = "step int, level int, lcc double, p array<double>, steps int, centre array<double>, axes array<double>"

    def __init__(self, spark, root: str, name: str):
        self.spark, self.path = spark, f"{root}/states/run={name}"

    def reached(self) -> list[tuple[int, Outcome]]:
        """Level (-1: the initial transform) and outcome of each finished step, in order; of a step that was done twice, one."""
        try:
            rows = sorted(self.spark.read.schema(self.SCHEMA).parquet(self.path).dropDuplicates(["step"]).collect())
        except AnalysisException:
            return []
        array = lambda x, *shape: None if x is None else np.array(x).reshape(*shape)
        return [(r.level, Outcome(r.lcc, np.array(r.p), r.steps, array(r.centre, 3), array(r.axes, 3, 3))) for r in rows]

    def add(self, step: int, level: int, o: Outcome) -> None:
        listed = lambda a: None if a is None else [float(x) for x in np.ravel(a)]
        row = (step, level, float(o.lcc), listed(o.p), int(o.steps), listed(o.centre), listed(o.axes))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


@contextlib.contextmanager
def _both(fixed: _Levels, moving: _Levels, i: int):
    fc, mc = fixed.chunks(i), moving.chunks(i)
    try:
        yield fc, mc
    finally:
        fc.rows.unpersist()
        mc.rows.unpersist()
