"""Driver loops of the registration; every evaluation is one distributed sum over chunks."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from ..functions.geometry import corner_shift, matrix_from_p, p_from_matrix, rotation_matrix, rotation_step
from ..operators.blocks import voxels
from ..operators.lcc import Chunks, InsufficientOverlapError, Overlap, Similarity, evaluate
from ..operators.statistics import edge_moment_sums, inertia


TIE = 1e-9  #: similarity values that differ by less are equal


@dataclass(frozen=True)
class Outcome:
    """Best similarity, its parameters and the number of passes or steps; from moments, also the fixed centroid and axes."""

    lcc: float
    p: np.ndarray
    steps: int
    centre: np.ndarray | None = None
    axes: np.ndarray | None = None


def descent_moves(start: np.ndarray, moved: np.ndarray, centre: np.ndarray, axes: np.ndarray, shift: float, angle: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The twelve moves of a pass after `moved`, and the parameters that each gives from the matrix `start`: shifts along the axes and turns about them, both ways.

    A move is undone on the fixed side, about `centre`, before the initial transform.
    """
    there, back = np.eye(4), np.eye(4)
    there[:3, 3], back[:3, 3] = -np.asarray(centre), centre
    moves = []
    for turn, i, s in itertools.product((False, True), range(3), (1, -1)):
        d = np.eye(4)
        if turn:
            d[:3, :3] = rotation_matrix(s * angle * axes[:, i])
        else:
            d[:3, 3] = s * shift * axes[:, i]
        moves.append(d @ moved)
    return moves, [p_from_matrix(start @ back @ np.linalg.inv(d) @ there) for d in moves]


def simple_gradient(overlap: Overlap, p0: np.ndarray, centre: np.ndarray | None = None, axes: np.ndarray | None = None, step: float = 2.0, least: float = 0.25, most: int = 50) -> Outcome:
    """Rigid descent: of twelve moves (six shifts, six turns along and about the fixed image's `axes` through its `centre`) the best is taken, or the step halved.

    All moves of a pass are evaluated in one job. Steps are in moving voxels.
    """
    if len(p0) != 6:
        raise NotImplementedError("only rigid transforms")
    m = overlap.moving.meta
    centre = overlap.fixed.meta.centre if centre is None else centre
    axes = np.eye(3) if axes is None else axes
    start, moved = matrix_from_p(p0), np.eye(4)
    best = overlap.evaluate([p0])[0]
    if not best.n:
        raise InsufficientOverlapError("the images do not overlap under the initial transform")
    best_lcc, best_p, passes, size = best.lcc, np.asarray(p0, float), 0, float(np.linalg.norm(m.spacing))
    while step >= least and passes < most:
        passes += 1
        moves, ps = descent_moves(start, moved, centre, axes, step * size, rotation_step(m, step, centre))
        got = overlap.evaluate(ps, around=best_p)
        i = min(range(len(got)), key=lambda j: got[j].lcc if got[j].n else np.inf)
        if got[i].n and got[i].lcc < best_lcc:
            best_lcc, best_p, moved = got[i].lcc, ps[i], moves[i]
        else:
            step /= 2
    return Outcome(best_lcc, best_p, passes)


def updated(p: np.ndarray, s: Similarity, damping: float) -> np.ndarray:
    """The damped Gauss-Newton step; a rigid one is applied on the fixed side."""
    h = s.hessian + damping * np.diag(np.diag(s.hessian))
    d = -np.linalg.lstsq(h, s.gradient, rcond=None)[0]
    if len(p) == 6:
        return p_from_matrix(matrix_from_p(p) @ np.linalg.inv(matrix_from_p(d)))
    m = np.eye(4)
    m[:3] += d.reshape(3, 4)
    return p_from_matrix(matrix_from_p(p) @ np.linalg.inv(m), affine=True)


def levenberg_marquardt(overlap: Overlap, p0: np.ndarray, damping: float = 0.1, up: float = 5.0, down: float = 0.2, most: int = 50, most_up: int = 4, min_shift: float = 0.01) -> Outcome:
    """Returns the best point seen. Ends when a downhill step moves no corner by `min_shift` voxels, or after `most_up` steps that did not help."""
    f, m = overlap.fixed.meta, overlap.moving.meta
    best_p, best, ups = np.asarray(p0, float), overlap.evaluate([p0], True)[0], 0
    if not best.n:
        raise InsufficientOverlapError("the images do not overlap under the initial transform")
    steps = 0
    while steps < most and ups < most_up:
        steps += 1
        trial = updated(best_p, best, damping)
        got = overlap.evaluate([trial], True)[0]
        if got.n and got.lcc <= best.lcc:
            shift = corner_shift(m, matrix_from_p(best_p), matrix_from_p(trial), f)
            best_p, best, ups, damping = trial, got, 0, damping * down
            if shift < min_shift:
                break
        else:
            ups, damping = ups + 1, damping * up
    return Outcome(best.lcc, best_p, steps)


def proper_rotations(f_axes: np.ndarray, m_axes: np.ndarray) -> list[np.ndarray]:
    """The 24 rotations that turn one set of axes into the other, up to order and sign."""
    out = []
    for order in itertools.permutations(range(3)):
        for signs in itertools.product((1, -1), repeat=3):
            r = (m_axes[:, order] * np.array(signs)) @ f_axes.T
            if abs(np.linalg.det(r) - 1) < 1e-3:
                out.append(r)
    return out


def overlapping(got: Sequence[Similarity], share: float = 0.75) -> list[int]:
    """Candidates with at least that share of the largest number of voxels."""
    most = max((s.n for s in got), default=0)
    return [i for i, s in enumerate(got) if s.n and s.n >= int(share * most)]


def choice(got: Sequence[Similarity], candidates: Sequence[np.ndarray], allowed: Sequence[int], tie: float = TIE) -> int:
    """Of the least similarity values, equal but for `tie`, that with the most voxels; then that with the smallest angle; then the first."""
    least = min(got[j].lcc for j in allowed)
    tied = [j for j in allowed if got[j].lcc <= least + tie]
    return min(tied, key=lambda j: (-got[j].n, round(float(np.linalg.norm(candidates[j][3:])), 6), j))


def transform_from_moments(fixed: Chunks, moving: Chunks, shift_only: bool = False) -> Outcome:
    """Initial rigid transform from the edge moments of two masked images: identity, the centroids' shift if that is better, or the best
    proper rotation of the axes, all by one job. Of rotations those with very little overlap are left out. The outcome has the
    fixed image's centroid and, unless only shifts were tried, its axes, about which a descent then turns."""
    (_, cf, tf), (_, cm, tm) = (inertia(edge_moment_sums(voxels(c), c.meta.shape, c.meta.voxel_to_world).first()) for c in (fixed, moving))
    axes = np.linalg.eigh(tf)[1]
    candidates = [np.zeros(6), np.concatenate([cm - cf, np.zeros(3)])]
    if not shift_only:
        for r in proper_rotations(axes, np.linalg.eigh(tm)[1]):
            t = np.eye(4)
            t[:3, :3], t[:3, 3] = r, cm - r @ cf
            candidates.append(p_from_matrix(t))
    got = evaluate(fixed, moving, candidates)
    ok = [j for j in (0, 1) if got[j].n] + [j + 2 for j in overlapping(got[2:])]
    if not ok:
        raise InsufficientOverlapError("no candidate overlaps")
    i = choice(got, candidates, ok)
    return Outcome(got[i].lcc, candidates[i], len(candidates), cf, None if shift_only else axes)
