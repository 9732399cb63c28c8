"""Geometry of images and transforms: small matrices on the driver.

Coordinates are ordered x, y, z, arrays z, y, x. A rigid transform is (tx, ty, tz, rx, ry, rz) with a
rotation vector, an affine one the row-major upper 3 x 4 part of its matrix.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class ImageMeta:
    """Size in voxels, spacing and offset in mm, direction matrix by rows; all by x, y, z."""

    shape: tuple[int, int, int]
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    direction: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)

    @property
    def voxel_to_world(self) -> np.ndarray:
        m = np.eye(4)
        m[:3, :3] = np.array(self.direction).reshape(3, 3) * np.array(self.spacing)
        m[:3, 3] = self.offset
        return m

    @property
    def world_to_voxel(self) -> np.ndarray:
        try:
            return np.linalg.inv(self.voxel_to_world)
        except np.linalg.LinAlgError as e:
            raise ValueError("the voxel-to-world matrix is singular") from e

    @property
    def n_voxels(self) -> int:
        return int(np.prod(self.shape))

    @property
    def memory_mb(self) -> float:
        """Of sixteen-bit voxels."""
        return 2 * self.n_voxels / 2**20

    @property
    def voxel_surface(self) -> float:
        """Total surface of all voxels."""
        x, y, z = self.spacing
        return self.n_voxels * 2 * (x * y + x * z + y * z)

    @property
    def gradient_matrix(self) -> np.ndarray:
        """From central differences by voxel to a gradient in the world."""
        return np.array(self.direction).reshape(3, 3) @ np.diag(0.5 / np.array(self.spacing))

    @property
    def centre(self) -> np.ndarray:
        return transform_points(self.voxel_to_world, (np.array(self.shape, float) - 1) / 2)

    def corners(self, world: bool = True) -> np.ndarray:
        """The eight corner voxels, x fastest."""
        nx, ny, nz = (n - 1 for n in self.shape)
        out = np.array([(x, y, z) for z in (0, nz) for y in (0, ny) for x in (0, nx)], float)
        return transform_points(self.voxel_to_world, out) if world else out

    def part(self, offset: tuple[int, int, int], size: tuple[int, int, int]) -> ImageMeta:
        """Of the box of that size (x, y, z) that begins at that voxel."""
        return replace(self, shape=tuple(size), offset=tuple(transform_points(self.voxel_to_world, np.array(offset, float)).tolist()))

    def strided(self, skip: tuple[int, int, int]) -> ImageMeta:
        return replace(self, shape=tuple(-(-n // k) for n, k in zip(self.shape, skip, strict=True)), spacing=tuple(s * k for s, k in zip(self.spacing, skip, strict=True)))

    def resampled(self, shape: tuple[int, int, int]) -> ImageMeta:
        """Of the area average with that size: voxel centres move by half the scale."""
        scale = np.array(self.shape) / np.array(shape)
        origin = transform_points(self.voxel_to_world, 0.5 * scale - 0.5)
        return replace(self, shape=tuple(shape), spacing=tuple((np.array(self.spacing) * scale).tolist()), offset=tuple(origin.tolist()))

    def moved(self, transform: np.ndarray) -> ImageMeta:
        """Header-only resampling of a moving image by a rigid world transform: voxels stay, their place changes."""
        m = np.linalg.inv(transform) @ self.voxel_to_world
        return replace(self, offset=tuple(m[:3, 3].tolist()), direction=tuple((m[:3, :3] / np.array(self.spacing)).ravel().tolist()))


def transform_points(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.asarray(points) @ m[:3, :3].T + m[:3, 3]


def rotation_matrix(r: np.ndarray) -> np.ndarray:
    """From a rotation vector, by Rodrigues' formula."""
    angle = float(np.linalg.norm(r))
    if angle < 1e-300:
        return np.eye(3)
    x, y, z = np.asarray(r) / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def rotation_vector(m: np.ndarray) -> np.ndarray:
    """The rotation vector of a rotation matrix, by way of its unit quaternion."""
    m = np.asarray(m)[:3, :3]
    k = np.array([
        [m[0, 0] - m[1, 1] - m[2, 2], 0, 0, 0], [m[0, 1] + m[1, 0], m[1, 1] - m[0, 0] - m[2, 2], 0, 0],
        [m[0, 2] + m[2, 0], m[1, 2] + m[2, 1], m[2, 2] - m[0, 0] - m[1, 1], 0],
        [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1], m[0, 0] + m[1, 1] + m[2, 2]],
    ]) / 3
    q = np.linalg.eigh(k, UPLO="L")[1][:, -1]
    q = q if q[3] >= 0 else -q
    n = np.linalg.norm(q[:3])
    return np.zeros(3) if n < 1e-300 else q[:3] / n * 2 * np.arctan2(n, q[3])


def euler_degrees(m: np.ndarray) -> np.ndarray:
    """Angles about the fixed axes x, y, z, in this order."""
    m = np.asarray(m)
    y = -np.arcsin(np.clip(m[2, 0], -1, 1))
    if abs(m[2, 0]) < 1 - 1e-12:
        return np.degrees([np.arctan2(m[2, 1], m[2, 2]), y, np.arctan2(m[1, 0], m[0, 0])])
    return np.degrees([0.0, y, np.arctan2(-m[0, 1], m[1, 1])])


def matrix_from_p(p: np.ndarray) -> np.ndarray:
    p, m = np.asarray(p, float), np.eye(4)
    if len(p) == 6:
        m[:3, :3], m[:3, 3] = rotation_matrix(p[3:]), p[:3]
    elif len(p) == 12:
        m[:3] = p.reshape(3, 4)
    else:
        raise IndexError(f"6 or 12 parameters are needed, not {len(p)}")
    return m


def p_from_matrix(m: np.ndarray, affine: bool = False) -> np.ndarray:
    m = np.asarray(m, float)
    return m[:3].ravel().copy() if affine else np.concatenate([m[:3, 3], rotation_vector(m)])


def voxel_matrix(fixed: ImageMeta, moving: ImageMeta, world: np.ndarray) -> np.ndarray:
    """From fixed voxels to moving voxels."""
    return moving.world_to_voxel @ world @ fixed.voxel_to_world


def voxel_matrix_from_p(fixed: ImageMeta, moving: ImageMeta, p: np.ndarray) -> np.ndarray:
    return voxel_matrix(fixed, moving, matrix_from_p(p))


def swap_handedness(m: np.ndarray) -> np.ndarray:
    """Between right-anterior-superior and left-posterior-superior; its own inverse."""
    f = np.diag([-1.0, -1.0, 1.0, 1.0])
    return f @ m @ f


def rotation_step(image: ImageMeta, step: float, centre: np.ndarray) -> float:
    """The angle that moves the corner farthest from `centre` by `step` of the smallest spacing."""
    return step * min(image.spacing) / float(np.linalg.norm(image.corners() - centre, axis=1).max())


def corner_shift(moving: ImageMeta, before: np.ndarray, after: np.ndarray, fixed: ImageMeta) -> float:
    """Largest shift of a fixed corner between two world transforms, in moving voxels."""
    d = transform_points(moving.world_to_voxel @ after, fixed.corners()) - transform_points(moving.world_to_voxel @ before, fixed.corners())
    return float(np.linalg.norm(d, axis=1).max())


def transform_memory_mb(fixed: tuple[int, ...], moving: tuple[int, ...]) -> float:
    """For blocks of voxels that are held together with their interpolated values."""
    return (float(np.prod(fixed)) + float(np.prod(moving))) / 2**18


def transformed_block(offset: np.ndarray, size: np.ndarray, matrix: np.ndarray, moving: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of the moving voxels that a fixed block (x, y, z) may meet; size 0 where there are none."""
    o, s = np.asarray(offset), np.asarray(size)
    ends = np.array([[o[k] + (s[k] - 1) * ((i >> k) & 1) for k in range(3)] for i in range(8)], float)
    at = transform_points(matrix, ends)
    low = np.maximum(np.floor(at.min(0)).astype(int) - 1, 0)
    high = np.minimum(np.floor(at.max(0)).astype(int) + 2, np.array(moving) - 1)
    n = high - low + 1
    return low, n if (n > 0).all() else np.zeros(3, int)
