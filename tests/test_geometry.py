import numpy as np
import pytest

from voxspark.functions.geometry import (
    ImageMeta, corner_shift, euler_degrees, matrix_from_p, p_from_matrix, rotation_matrix, rotation_step, rotation_vector, swap_handedness, transform_points,
    transformed_block, voxel_matrix_from_p,
)
from voxspark.jobs.export import matrix_text, read_matrix, validation_text
from voxspark.jobs.pyramid import level_metas, plan_pyramid
from voxspark.jobs.register import Config, initial_matrix, read_config

OBLIQUE = ImageMeta((20, 24, 28), (0.5, 1.0, 2.0), (3.0, -4.0, 5.0), tuple(rotation_matrix([0.3, -0.2, 0.5]).ravel()))


def test_world_and_voxel_are_inverse():
    v = np.random.default_rng(0).normal(size=(50, 3))
    assert np.allclose(transform_points(OBLIQUE.world_to_voxel, transform_points(OBLIQUE.voxel_to_world, v)), v)
    with pytest.raises(ValueError):
        _ = ImageMeta((2, 2, 2), (0.0, 1.0, 1.0)).world_to_voxel


@pytest.mark.parametrize("r", [(0, 0, 0), (0.1, -0.2, 0.3), (3.1, 0.0, 0.0), (0, 2.0, -2.0), (1e-9, 0, 0)])
def test_rotation_vectors(r):
    m = rotation_matrix(np.array(r, float))
    assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(rotation_matrix(rotation_vector(m)), m)


def test_parameters_round_trip():
    p = np.array([1, -2, 3, 0.1, 0.2, -0.3])
    assert np.allclose(p_from_matrix(matrix_from_p(p)), p)
    a = np.arange(12.0)
    assert np.allclose(p_from_matrix(matrix_from_p(a), affine=True), a)
    with pytest.raises(IndexError):
        matrix_from_p(np.zeros(7))


def test_handedness_and_euler():
    m = matrix_from_p([1, 2, 3, 0.1, 0.2, 0.3])
    assert np.allclose(swap_handedness(swap_handedness(m)), m)
    x, y, z = np.radians(euler_degrees(m))
    assert np.allclose(rotation_matrix([0, 0, z]) @ rotation_matrix([0, y, 0]) @ rotation_matrix([x, 0, 0]), m[:3, :3])


def test_moved_header_equals_moved_points():
    m = matrix_from_p([1, 2, 3, 0.1, 0.2, 0.3])
    v = OBLIQUE.corners(world=False)
    assert np.allclose(transform_points(m, transform_points(OBLIQUE.moved(m).voxel_to_world, v)), OBLIQUE.corners())


def test_block_bounds_hold_all_transformed_points():
    m = voxel_matrix_from_p(OBLIQUE, OBLIQUE, np.array([0.4, -1, 2, 0.1, 0.05, -0.1]))
    low, size = transformed_block(np.array([2, 3, 4]), np.array([5, 6, 7]), m, OBLIQUE.shape)
    pts = transform_points(m, np.array([(x, y, z) for x in range(2, 7) for y in range(3, 9) for z in range(4, 11)], float))
    inside = ((pts >= 0) & (pts <= np.array(OBLIQUE.shape) - 1)).all(1)
    assert ((pts[inside] >= low) & (pts[inside] <= low + size - 1)).all()
    assert (transformed_block(np.zeros(3), np.full(3, 4), matrix_from_p([500, 0, 0, 0, 0, 0]), OBLIQUE.shape)[1] == 0).all()


def test_steps_and_shifts():
    angle = rotation_step(OBLIQUE, 1.0, OBLIQUE.centre)
    assert np.isclose(angle * np.linalg.norm(OBLIQUE.corners() - OBLIQUE.centre, axis=1).max(), 0.5)
    assert np.isclose(corner_shift(ImageMeta((8, 8, 8)), np.eye(4), matrix_from_p([3, 4, 0, 0, 0, 0]), ImageMeta((8, 8, 8))), 5)


def test_pyramid_plan():
    plan = plan_pyramid([ImageMeta((128, 128, 128)), ImageMeta((64, 128, 256), (2.0, 1.0, 1.0))])
    assert plan.spacing == (2.0, 1.0, 1.0) and plan.levels == 3
    assert [m.shape for m in level_metas(ImageMeta((64, 64, 64)), plan_pyramid([ImageMeta((64, 64, 64))]))] == [(64,) * 3, (32,) * 3, (16,) * 3, (8,) * 3]
    assert plan_pyramid([ImageMeta((6, 6, 6))]).levels == 0
    with pytest.raises(ValueError):
        plan_pyramid([ImageMeta((64, 64, 64))], min_scale=0.5)
    root = level_metas(ImageMeta((64, 64, 64)), plan_pyramid([ImageMeta((64, 64, 64))], sqrt2=True))
    assert root[1].shape == (45,) * 3 and root[2].shape == (32,) * 3


def test_config_is_typed_and_refers():
    c = read_config("[DEFAULT]\nf=0.25\n[transformation]\ntransformation_type = affine\n[masking]\nfixed_used_gradient_magnitude_fraction=${DEFAULT:f}\n[simple_gradient]\nactive=False\n[levenberg_marquardt]\nmax_nr_of_iterations=7\n")
    assert c.affine and c.fixed_fraction == 0.25 and not c.simple_gradient and c.most_steps == 7
    with pytest.raises(ValueError):
        read_config("[levenberg_marquardt]\nmax_nr_of_iterations=__import__('os').getpid()\n")
    with pytest.raises(ValueError):
        initial_matrix(np.eye(4), Config(moments=True))
    m = matrix_from_p([1, 2, 3, 0.1, 0, 0])
    assert np.allclose(initial_matrix(m, Config(inverted=True)) @ m, np.eye(4))


def test_texts():
    m = matrix_from_p([1 / 3, 2, 3, 0.1, 0, 0])
    assert (read_matrix(matrix_text(m)) == m).all()
    lines = validation_text(ImageMeta((3, 3, 3)), np.eye(4), "a header").splitlines()
    assert lines[0] == "a header" and lines[1] == lines[10] == "" and len(lines) == 13
    assert lines[3] == "  2  " + "".join(f"{x:11.4f}" for x in (2, 0, 0, 2, 0, 0))
