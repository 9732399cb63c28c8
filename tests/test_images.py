import os
import struct
from dataclasses import replace

import numpy as np
import pytest

from voxspark.functions.geometry import ImageMeta, matrix_from_p, rotation_matrix, voxel_matrix_from_p
from voxspark.jobs import export, masking, optimise, run
from voxspark.jobs.register import Config, register
from voxspark.operators import lcc, pointwise, resample, runs, statistics, stencil
from voxspark.operators import tiles as tiles_
from voxspark.operators.average import averaged
from voxspark.operators.blocks import masked_chunks, rimmed, voxels
from voxspark.operators.lcc import chunked, evaluate
from voxspark.operators.resample import grid_places
from voxspark.sources import isq, mhd, store


def table(spark, a):
    z, y, x = (i.ravel().tolist() for i in np.indices(a.shape))
    return spark.createDataFrame(list(zip(z, y, x, map(int, a.ravel()), strict=True)), "z int, y int, x int, v int")


def array(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.z, r.y, r.x] = r.v
    return out


def phantom(n, p=None, centre=None):
    """A smooth image, seen through the inverse of the transform p."""
    z, y, x = np.indices((n, n, n)).astype(float)
    pts = np.stack([x, y, z], -1)
    if p is not None:
        m = np.linalg.inv(matrix_from_p(p))
        pts = pts @ m[:3, :3].T + m[:3, 3]
    x, y, z = pts[..., 0], pts[..., 1], pts[..., 2]
    g = np.sin(0.5 * x + 0.2 * y) + np.sin(0.45 * y - 0.3 * z) + np.sin(0.4 * z + 0.25 * x) + 0.5 * np.sin(0.3 * (x + y + z))
    return np.rint(2000 + 500 * g).astype(int)


@pytest.fixture(scope="module")
def small():
    return np.random.default_rng(3).integers(1, 1000, (9, 10, 11))


def test_gradient_and_masks_against_arrays(spark, small):
    shape, rows = small.shape[::-1], table(spark, small)
    g = stencil.gradient_magnitude(rows, shape).collect()
    d = lambda axis: np.roll(small, -1, axis) - np.roll(small, 1, axis)
    want = (d(0) ** 2 + d(1) ** 2 + d(2) ** 2)[1:-1, 1:-1, 1:-1]
    got = np.zeros_like(small)
    for r in g:
        got[r.z, r.y, r.x] = r.gm
    assert (got[1:-1, 1:-1, 1:-1] == want).all() and len(g) == want.size
    assert {r.z for r in stencil.gradient_magnitude(rows, shape, last_z_empty=True).collect()} == set(range(1, 7))
    limit = np.quantile(want, 0.9)
    for moving in (False, True):
        near = np.zeros(small.shape, bool)
        core = np.zeros(small.shape, bool)
        core[1:-1, 1:-1, 1:-1] = want > limit
        for z, y, x in np.argwhere(core):
            for a in range(-2, 3):
                for b in range(-2, 3):
                    for c in range(-2, 3):
                        q = (z + a, y + b, x + c)
                        if (moving or abs(a) + abs(b) + abs(c) <= 2) and all(0 <= i < n for i, n in zip(q, small.shape, strict=True)):
                            near[q] = True
        made = array(stencil.edge_mask(rows, stencil.gradient_magnitude(rows, shape), limit, moving), small.shape)
        assert (made == np.where(core, small, np.where(near, -small, 0))).all()


def test_constant_image_has_an_empty_mask(spark):
    meta = ImageMeta((8, 8, 8))
    masked = masking.mask_image(table(spark, np.full((8, 8, 8), 7)), meta, 0.1, False)
    assert statistics.mask_stats(masked).first().n_background == 512
    with pytest.raises(ValueError):
        statistics.inertia(statistics.edge_moment_sums(masked, meta.shape, np.eye(4)).first())


def test_area_average_against_arrays(spark, small):
    for to in ((5, 5, 4), (11, 10, 9), (8, 7, 6), (1, 1, 1)):
        w = []
        for n, m in zip(small.shape[::-1], to, strict=True):
            o, i = np.arange(m)[:, None], np.arange(n)[None]
            w.append(np.maximum(0, np.minimum((o + 1) * n, (i + 1) * m) - np.maximum(o * n, i * m)))
        total = np.einsum("cz,by,ax,zyx->cba", w[2], w[1], w[0], small)
        den = small.size
        got = array(resample.downsample(table(spark, small), small.shape[::-1], to), to[::-1])
        assert (got == (2 * total + den) // (2 * den)).all()
    with pytest.raises(ValueError):
        resample.downsample(table(spark, small), small.shape[::-1], (12, 10, 9))


def test_averages_by_prefix_sums_are_the_relational_ones(spark, small):
    """Chunks that cut cells on every face, images and masks; one exchange after the chunks."""
    meta = ImageMeta(small.shape[::-1])
    for to in ((5, 5, 4), (11, 10, 9), (8, 7, 6), (1, 1, 1)):
        for mask in (False, True):
            a = (small > 700).astype(int) if mask else small
            want = array(resample.downsample(table(spark, a), meta.shape, to, mask), to[::-1])
            for edge in (4, 32):
                got = averaged(chunked(table(spark, a), meta, 0, edge), meta.resampled(to), mask)
                assert (array(voxels(got), to[::-1]) == want).all() and sum(r.n_core for r in got.rows.select("n_core").collect()) == (want > 0).sum()
    kept = chunked(table(spark, small), meta, 0, 4)
    rows = spark.createDataFrame(kept.rows.collect(), kept.rows.schema)
    plan = averaged(replace(kept, rows=rows), meta.resampled((5, 5, 4))).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        averaged(kept, ImageMeta((12, 10, 9)))


def test_rims_are_put_on_chunks(spark):
    """As voxels are cut into chunks with a rim; chunks that only have a rim come too."""
    rng = np.random.default_rng(3)
    a = np.zeros((13, 14, 15), int)
    a[5:9, 2:7, 8:] = rng.integers(1, 900, (4, 5, 7))
    meta, rows = ImageMeta((15, 14, 13)), table(spark, a)
    for edge, halo in ((4, 3), (6, 5), (32, 3)):
        place = lambda c: {(r.cz, r.cy, r.cx): (r.n_core, bytes(r.data)) for r in c.rows.collect() if any(r.data)}
        inside = lambda d: {k: v for k, v in d.items() if all(0 <= c <= (n - 1) // edge for c, n in zip(k, a.shape, strict=True))}
        assert place(rimmed(chunked(rows, meta, 0, edge), halo)) == inside(place(chunked(rows, meta, halo, edge)))


def test_masks_of_chunks_are_those_of_voxels(spark):
    rng = np.random.default_rng(9)
    a, keep = rng.integers(1, 900, (13, 14, 15)), (rng.random((13, 14, 15)) < 0.7).astype(int)
    a[:3, :5, :6] = keep[8:, 8:, 8:] = 0
    meta, rows = ImageMeta((15, 14, 13)), table(spark, a)
    for moving, mask in ((False, None), (True, table(spark, keep)), (False, table(spark, keep))):
        want = array(masking.mask_image(rows, meta, 0.2, moving, mask), a.shape)
        c = masked_chunks(chunked(rows, meta, 0, 6), meta, 0.2, moving, mask and chunked(mask, meta, 0, 6))
        assert (array(voxels(c), a.shape) == want).all() and (want > 0).any()
        c.rows.unpersist()


def _masked(a, rng):
    out = np.where(rng.random(a.shape) < 0.6, a, -a)
    out[rng.random(a.shape) < 0.03] = 0
    return out


def test_chunks_agree_with_the_relational_form(spark):
    rng = np.random.default_rng(5)
    a = _masked(rng.integers(1, 900, (14, 15, 16)), rng)
    b = _masked(np.abs(np.roll(a, 1, 2)) + rng.integers(0, 3, a.shape), rng)
    f = m = ImageMeta((16, 15, 14))
    ps = [np.array([*t, *r]) for t, r in (((1.0, 0, 0), (0, 0, 0)), ((0.7, 0.2, -0.4), (0.02, -0.03, 0.05)), ((90.0, 0, 0), (0, 0, 0)))]
    fixed, moving = table(spark, a), table(spark, b)
    got = evaluate(chunked(fixed, f, 2, edge=6), chunked(moving, m, 0, edge=6), ps)
    for p, s in zip(ps, got, strict=True):
        r = lcc.lcc_value(fixed, moving, f.shape, m.shape, voxel_matrix_from_p(f, m, p)).first()
        assert s.n == r.n
        assert not s.n or np.isclose(s.lcc, r.lcc)
    assert got[2].n == 0


@pytest.mark.parametrize("most", [1 << 21, 300])
def test_candidates_in_one_job(spark, most):
    """As the relational form, and in the bits of kept boxes; poses that lie apart have boxes of their own, and one without overlap has no row."""
    rng = np.random.default_rng(9)
    a = _masked(rng.integers(1, 900, (14, 15, 16)), rng)
    b = _masked(np.abs(np.roll(a, 1, 2)) + rng.integers(0, 3, a.shape), rng)
    f = ImageMeta((16, 15, 14))
    ps = [np.array(p) for p in ((1.0, 0, 0, 0, 0, 0), (90.0, 0, 0, 0, 0, 0), (0.7, 0.2, -0.4, 0.02, -0.03, 0.05), (-4.0, 3, 0.5, 0, 0, 0), (1.0, 0.5, 0, 0, 0, 0))]
    matrices = [voxel_matrix_from_p(f, f, p) for p in ps]
    voxels = table(spark, a), table(spark, b)
    fixed, moving = chunked(voxels[0], f, 2, edge=6), chunked(voxels[1], f, 0, edge=6)
    got = {r.candidate: (r.n, r.lcc) for r in lcc.lcc_candidates(fixed, moving, matrices, most=most).collect()}
    assert got == {i: (s.n, s.lcc) for i, s in enumerate(evaluate(fixed, moving, ps)) if s.n} and sorted(got) == [0, 2, 3, 4]
    for i, (n, value) in got.items():
        r = lcc.lcc_value(*voxels, f.shape, f.shape, matrices[i]).first()
        assert n == r.n and np.isclose(value, r.lcc)


def test_similarity_is_invariant_under_linear_grey_maps(spark):
    a = phantom(12)
    f = ImageMeta((12, 12, 12))
    fixed = chunked(table(spark, a), f, 2)
    for b in (a, 3 * a + 7, 9000 - a):
        assert evaluate(fixed, chunked(table(spark, b), f, 0), [np.zeros(6)])[0].lcc < 1e-9


@pytest.mark.parametrize("affine", [False, True])
def test_levenberg_marquardt_finds_the_pose(spark, affine):
    p = np.array([0.8, -0.5, 0.4, 0.05, -0.04, 0.03])
    f = ImageMeta((24, 24, 24))
    fixed, moving = chunked(table(spark, phantom(24)), f, 2), chunked(table(spark, phantom(24, p)), f, 0)
    start = p_start = np.zeros(6) if not affine else np.eye(4)[:3].ravel()
    s = evaluate(fixed, moving, [start], True)[0]
    assert s.n > 500 and np.linalg.norm(s.gradient) > 0 and (np.linalg.eigvalsh(s.hessian) > -1e-9).all()
    with lcc.Overlap(fixed, moving) as overlap:
        out = optimise.levenberg_marquardt(overlap, p_start, most=8)
        assert overlap.cuts == 1
    shift = optimise.corner_shift(f, matrix_from_p(out.p), matrix_from_p(p), f)
    assert shift < 0.1 and out.lcc < 0.01


def test_registration_from_coarse_to_fine(spark):
    p = np.array([1.6, -1.1, 0.7, 0.0, 0.0, 0.04])
    f = ImageMeta((24, 24, 24))
    got = register(table(spark, phantom(24)), f, table(spark, phantom(24, p)), f, Config(fixed_fraction=0.5, moving_fraction=0.5, min_voxels=1000, most_steps=8))
    assert len(got.levels) == 2 and optimise.corner_shift(f, got.matrix, matrix_from_p(p), f) < 0.15


def test_a_run_goes_on_after_a_lost_driver(spark, tmp_path, monkeypatch):
    """Stopped after a level, the run ends with the same parameters as an unbroken one, and finished levels are not done again."""
    from voxspark.jobs import register as module

    p, f = np.array([1.6, -1.1, 0.7, 0.0, 0.0, 0.04]), ImageMeta((24, 24, 24))
    still, moved = table(spark, phantom(24)), table(spark, phantom(24, p))
    config = Config(fixed_fraction=0.5, moving_fraction=0.5, min_voxels=1000, most_steps=4, moments=True)
    whole = register(still, f, moved, f, config)
    real, calls = module.levenberg_marquardt, []

    def stopping(overlap, *given):
        calls.append(overlap.fixed.meta.shape)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(overlap, *given)

    monkeypatch.setattr(module, "levenberg_marquardt", stopping)
    states = module.States(spark, str(tmp_path), "a")
    with pytest.raises(KeyboardInterrupt):
        register(still, f, moved, f, config, states=states)
    assert [level for level, _ in states.reached()] == [-1, 1]
    monkeypatch.setattr(module, "simple_gradient", None)
    monkeypatch.setattr(module, "transform_from_moments", None)
    again = register(still, f, moved, f, config, states=module.States(spark, str(tmp_path), "a"))
    assert (again.p == whole.p).all() and again.lcc == whole.lcc and [o.steps for o in again.levels] == [o.steps for o in whole.levels] and len(calls) == 3
    assert (register(still, f, moved, f, config, states=module.States(spark, str(tmp_path), "a")).p == whole.p).all() and len(calls) == 3


def test_no_overlap_and_moments(spark):
    f = ImageMeta((16, 16, 16))
    z, y, x = np.indices((16, 16, 16))
    blob = lambda c, r: np.where(((x - c[0]) / r[0]) ** 2 + ((y - c[1]) / r[1]) ** 2 + ((z - c[2]) / r[2]) ** 2 <= 1, 300 + 9 * (x - c[0]) * (y - c[1]) + 5 * (z - c[2]) ** 2, 0)
    a, b = blob((6, 7, 7), (3, 4, 5)), blob((8, 8, 7), (3, 4, 5))
    fixed, moving = chunked(table(spark, a), f, 2), chunked(table(spark, b), f, 0)
    with pytest.raises(lcc.InsufficientOverlapError), lcc.Overlap(fixed, moving) as overlap:
        optimise.levenberg_marquardt(overlap, np.array([60.0, 0, 0, 0, 0, 0]))
    out = optimise.transform_from_moments(fixed, moving, shift_only=True)
    assert np.allclose(out.p[:3], [2, 1, 0], atol=0.3)
    assert len(optimise.proper_rotations(np.eye(3), rotation_matrix([0.1, 0.2, 0.3]))) == 24


def test_moments_of_a_turned_ellipsoid(spark):
    """Three distinct axes, turned by 40 degrees and moved, with an odd term along each: the best of the 24 rotations is near enough for the descent."""
    shape = (32, 40, 48)
    z, y, x = np.indices(shape).astype(float)
    centre, axes = np.array([23.5, 19.5, 15.5]), np.array([17.0, 11.0, 7.0])
    p = np.array([2.0, -1.0, 1.0, 0.0, 0.0, np.radians(40)])
    m = matrix_from_p(p)
    m[:3, 3] = centre - m[:3, :3] @ centre + p[:3]

    def seen(inverse):
        q = np.stack([x, y, z], -1) @ inverse[:3, :3].T + inverse[:3, 3] - centre
        r = (q / axes) ** 2
        return np.rint(np.where(r.sum(-1) < 1, 900 - 500 * r.sum(-1) + (np.array([60, 50, 40]) * np.sin(q * [0.5, 0.6, 0.7])).sum(-1) + 40 * np.cos(0.6 * q[..., 1] + 0.4 * q[..., 2]), 20)).astype(int)

    f = ImageMeta(shape[::-1])
    fixed, moving = (masked_chunks(table(spark, seen(i)), f, 0.08, kind) for i, kind in ((np.eye(4), False), (np.linalg.inv(m), True)))
    out = optimise.transform_from_moments(fixed, moving)
    assert optimise.corner_shift(f, matrix_from_p(out.p), m, f) < 3 and out.steps == 26
    with lcc.Overlap(fixed, moving) as overlap:
        got = optimise.levenberg_marquardt(overlap, out.p, most=6)
    assert optimise.corner_shift(f, matrix_from_p(got.p), m, f) < 0.5


def test_equal_similarities_are_decided_by_rule():
    s, p = (lambda n, v: lcc.Similarity(n, v)), [np.array([0, 0, 0, 0, 0, a]) for a in (0.0, 3.0, 1.0, 1.0)]
    assert optimise.choice([s(5, 0.2), s(9, 0.1), s(9, 0.1 + 1e-12), s(9, 0.1)], p, range(4)) == 2
    assert optimise.choice([s(5, 0.1), s(9, 0.1), s(8, 0.1), s(9, 0.2)], p, range(4)) == 1
    assert optimise.choice([s(5, 0.1), s(9, 0.1), s(8, 0.1), s(9, 0.05)], p, [0, 2]) == 2


def test_moves_are_undone_on_the_fixed_side():
    """A turn leaves the fixed centre where the initial transform took it; a shift goes against the axis before that transform."""
    start, centre, axes = matrix_from_p([1, 2, 3, 0.3, -0.2, 0.5]), np.array([4.0, -5.0, 6.0]), rotation_matrix([0.2, 0.4, -0.1])
    moves, ps = optimise.descent_moves(start, np.eye(4), centre, axes, 2.0, 0.1)
    assert len(moves) == len(ps) == 12
    for i, p in enumerate(ps):
        got, want = matrix_from_p(p)[:3] @ np.append(centre, 1), start[:3] @ np.append(centre - (axes[:, i // 2] * (2, -2)[i % 2] if i < 6 else 0), 1)
        assert np.allclose(got, want)
    assert np.allclose(matrix_from_p(ps[6])[:3, :3], start[:3, :3] @ rotation_matrix(-0.1 * axes[:, 0]))


def _overlap(spark, edge=8, **more):
    f = ImageMeta((24, 24, 24))
    a, b = phantom(24), phantom(24, np.array([0.8, -0.5, 0.4, 0.05, -0.04, 0.03]))
    return lcc.Overlap(chunked(table(spark, a), f, 2, edge), chunked(table(spark, b), f, 0, edge), **more)


def test_steps_within_the_margin_move_no_voxels(spark):
    """Ten steps: no exchange of data in a plan, and hardly a byte shuffled; boxes are cut anew only where the pose leaves the margin."""
    with _overlap(spark, margin=4) as overlap:
        overlap.evaluate([np.zeros(6)])
        text = overlap.partials([np.array([0.5, 0, 0, 0, 0, 0])])._jdf.queryExecution().executedPlan().toString()
        before, _, after = text.partition("InMemoryTableScan")
        assert before.count("Exchange") == 1 and "limb" in before.partition("Exchange")[2].partition("\n")[0] + before and "FlatMapCoGroups" not in before

        def shuffled():
            sc, jvm = spark.sparkContext, spark._jvm
            none = jvm.java.util.ArrayList()
            stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
            return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

        start = shuffled()
        for i in range(10):
            overlap.evaluate([np.array([0.2 * i, -0.1 * i, 0, 0, 0, 0.005 * i])])
        assert overlap.cuts == 1 and shuffled() - start < 10 * 4 * 5_000
        want = overlap.evaluate([np.array([9.0, 0, 0, 0, 0, 0])])[0]
        assert overlap.cuts == 2
    with _overlap(spark) as overlap:
        again = overlap.evaluate([np.array([9.0, 0, 0, 0, 0, 0])])[0]
    assert (want.n, want.lcc) == (again.n, again.lcc) and want.n > 0


def test_few_sums_go_to_the_driver_with_the_same_bits(spark, monkeypatch):
    """Sums as tasks give them, and added up in Spark; the boxes' table is deleted at the end."""
    ps = [np.zeros(6), np.array([0.5, 0, 0, 0, 0.01, 0])]
    with _overlap(spark) as overlap:
        one = overlap.evaluate(ps, True)
        path = overlap.path.removeprefix("file://")
        assert overlap.few(ps, True) and os.path.isdir(path)
        monkeypatch.setattr(lcc, "FEW_ROWS", 0)
        two = overlap.evaluate(ps, True)
        assert not overlap.few(ps, True)
    assert not os.path.exists(path)
    for a, b in zip(one, two, strict=True):
        assert (a.n, a.lcc) == (b.n, b.lcc) and (a.gradient == b.gradient).all() and (a.hessian == b.hessian).all()


def test_pairs_are_bounded_by_arithmetic(spark):
    """No more pairs than the bound under shifts, turns and scales; none is given where a tile may be cut."""
    rng = np.random.default_rng(5)
    for _ in range(6):
        grid, shape, edge = rng.integers(5, 40, 3).tolist(), rng.integers(5, 40, 3).tolist(), int(rng.integers(3, 9))
        m = np.eye(4)
        m[:3, :3] += rng.normal(0, 0.5, (3, 3))
        m[:3, 3] = rng.normal(0, 6, 3)
        tiles = tiles_.planned(grid_places(spark, grid, edge), edge, grid, [m], shape, 1, 2, 1 << 20).where("sz > 0")
        pairs = sum(int(np.prod([(r[f"b{k}"] + r[f"s{k}"] - 1) // edge - r[f"b{k}"] // edge + 1 for k in "zyx"])) for r in tiles.collect())
        assert 0 <= pairs <= tiles_.pair_bound(edge, grid, [m], shape, 1, 2, 1 << 20)
    assert tiles_.pair_bound(8, (40, 40, 40), [np.diag([4.0, 4, 4, 1])], (80, 80, 80), 1, 2, 1000) is None


def test_sums_do_not_depend_on_partitions(spark):
    """Equal bits for 1, 7 and 50 partitions, with derivatives."""
    got, p = [], [np.array([0.3, 0.1, -0.2, 0.02, 0.0, 0.01])]
    with _overlap(spark) as made:
        for n in (1, 7, 50):
            with lcc.Overlap(replace(made.fixed, rows=made.fixed.rows.repartition(n)), made.moving) as overlap:
                overlap.cover(p)
                overlap.rows = overlap.rows.repartition(n)
                s = overlap.evaluate(p, True)[0]
            got.append((s.n, s.lcc, s.gradient.tolist(), s.hessian.tolist()))
    assert got[0] == got[1] == got[2] and got[0][0] > 500


@pytest.mark.parametrize("most", [1 << 21, 20_000, 3_000])
def test_boxes_are_bounded_under_any_transform(spark, most):
    """Scale 8 and shear: tiles are cut in eighths until their boxes are small enough, and the value stays that of the relational form."""
    rng = np.random.default_rng(5)
    a, b = _masked(rng.integers(1, 900, (12, 12, 12)), rng), _masked(rng.integers(1, 900, (40, 44, 48)), rng)
    f, m = ImageMeta((12, 12, 12), (8.0, 8.0, 8.0)), ImageMeta((48, 44, 40))
    p = np.array([0.5, 0.02, 0.01, 1.0, 0.0, 0.45, 0.03, 0.5, 0.01, 0.0, 0.45, 0.25])
    matrix = voxel_matrix_from_p(f, m, p)
    matrix[:3] = np.round(matrix[:3] * 64) / 64
    fixed, moving = table(spark, a), table(spark, b)
    want = lcc.lcc_value(fixed, moving, f.shape, m.shape, matrix).first()
    world = m.voxel_to_world @ matrix @ f.world_to_voxel
    with lcc.Overlap(chunked(fixed, f, 2, 8), chunked(moving, m, 0, 8), margin=0, most=most) as overlap:
        got = overlap.evaluate([world[:3].ravel()])[0]
        size = [r.sz * r.sy * r.sx for r in overlap.rows.select("sz", "sy", "sx").collect()]
        assert max(size) <= most and (most > 20_000 or len(size) > 8)
    assert got.n == want.n > 30 and np.isclose(got.lcc, want.lcc, rtol=1e-12)


@pytest.mark.parametrize("edge", [6, 32])
def test_masks_by_chunks_are_those_by_voxels(spark, edge):
    rng = np.random.default_rng(9)
    a = rng.integers(1, 900, (13, 14, 15))
    a[:3, :5, :6] = 0
    keep = (rng.random(a.shape) < 0.7).astype(int)
    meta, rows = ImageMeta((15, 14, 13)), table(spark, a)
    for moving in (False, True):
        for mask in (None, table(spark, keep)):
            want = array(masking.mask_image(rows, meta, 0.2, moving, mask), a.shape)
            c = masked_chunks(rows, meta, 0.2, moving, mask, edge)
            assert (array(voxels(c), a.shape) == want).all() and (want > 0).any()
            assert sum(r.n_core for r in c.rows.collect()) == (want > 0).sum()
            c.rows.unpersist()


def test_masks_need_their_images_geometry(spark):
    f, rows = ImageMeta((8, 8, 8)), table(spark, np.full((8, 8, 8), 5))
    with pytest.raises(ValueError, match="geometry of moving mask"):
        register(rows, f, rows, f, moving_mask=(ImageMeta((8, 8, 8), (1.0, 1.0, 1.1)), rows))


def test_images_are_stored_and_opened(spark, tmp_path, small):
    meta, root = ImageMeta((11, 10, 9), (0.1, 1 / 3, 2.0), (1.0, -2.0, 1e-9)), f"file://{tmp_path}/store"
    assert not store.has_image(spark, root, "a")
    store.save_image(spark, root, "a", table(spark, np.where(small > 500, small, 0)), meta, 10, {"DimSize": "11 10 9"}, ["made"])
    back, rows = store.open_image(spark, root, "a")
    assert back == meta and (array(rows, small.shape) == np.where(small > 500, small, 0)).all() and store.stored(spark, root, "a").lv_max == 1023**2
    store.empty_like(spark, root, "a", "b")
    assert store.open_image(spark, root, "b")[0] == meta and store.open_image(spark, root, "b")[1].count() == 0
    assert store.stored(spark, root, "b").log == ("made",) and store.has_image(spark, root, "b")


def test_a_box_of_a_level_reads_its_zones_alone(spark, tmp_path, monkeypatch):
    """Pyramids and masks are stored by level and zone; the plan names the zones of a box, and no other file is read."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(store, "ZONE", 2)
    a = np.random.default_rng(4).integers(0, 900, (20, 24, 28))
    a[:, :, 12:20] = 0
    meta, root = ImageMeta((28, 24, 20), (1.0, 0.5, 2.0)), f"file://{tmp_path}/store"
    base = chunked(table(spark, a), meta, 0, 4)
    levels = [base, averaged(base, meta.resampled((14, 12, 10)))]
    store.save_pyramid(spark, root, "a", levels, 10, log=["made"])
    back = store.open_pyramid(spark, root, "a")
    assert [c.meta for c in back] == [c.meta for c in levels] and (array(voxels(back[0]), a.shape) == a).all()
    half = array(voxels(back[1]), (10, 12, 14))
    assert (half == array(voxels(levels[1]), half.shape)).all() and half.any()
    limits = {(r.cz, r.cy, r.cx): (r.n_core, r.least, r.most) for r in back[0].rows.collect()}
    assert limits[1, 1, 1] == ((a[4:8, 4:8, 4:8] > 0).sum(), a[4:8, 4:8, 4:8].min(), a[4:8, 4:8, 4:8].max()) and (0, 0, 4) not in limits
    part, box = store.open_box(spark, root, "a", (5, 3, 2), (4, 6, 5), level=0)
    assert part == meta.part((5, 3, 2), (4, 6, 5)) and (array(box, (5, 6, 4)) == a[2:7, 3:9, 5:9]).all()
    some = store.part_of(back[0], (5, 3, 2), (4, 6, 5)).rows
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan or "zone#" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "GreaterThanOrEqual(cz,0)" in plan.partition("PushedFilters")[2]
    files = {r[0] for r in some.select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in back[0].rows.select(F.input_file_name()).distinct().collect()}
    assert {f.partition("zone=")[2].partition("/")[0] for f in files} == {"0", "1", str(10**7), str(10**7 + 1)} and len(files) < len(every) / 2
    masked = masked_chunks(table(spark, a), meta, 0.2, False, edge=4)
    store.save_pyramid(spark, root, "mask", [masked], 10)
    again = store.open_level(spark, root, "mask")
    assert again.halo == 2 and (array(voxels(again), a.shape) == array(voxels(masked), a.shape)).all()


def test_differences_of_files(spark, tmp_path, small):
    """In the first file's element type, which wraps; sizes must agree."""
    other = np.roll(small, 1, 2)
    a, b, c = _write(tmp_path, "a", small), _write(tmp_path, "b", other, "MET_FLOAT"), _write(tmp_path, "c", small[1:])
    d = _write(tmp_path, "d", other)
    for absolute, want in ((True, np.abs(small - other)), (False, (small - other) % 65536)):
        run.difference_files(spark, a, d, f"{tmp_path}/out.mhd", absolute)
        meta, rows = mhd.read_mhd(spark, f"{tmp_path}/out.mhd")
        assert mhd.read_header(f"{tmp_path}/out.mhd")["ElementType"] == "MET_USHORT" and (array(rows.withColumnRenamed("g", "v"), small.shape) == want).all()
    run.difference_files(spark, b, a, f"{tmp_path}/out.mhd", False)
    assert (array(mhd.read_mhd(spark, f"{tmp_path}/out.mhd")[1].withColumnRenamed("g", "v"), small.shape) == other - small).all()
    with pytest.raises(ValueError, match="sizes differ"):
        run.difference_files(spark, a, c, f"{tmp_path}/out.mhd")


def _write(folder, name, a, element="MET_USHORT", meta=None):
    (folder / f"{name}.raw").write_bytes(a.astype(mhd.ELEMENTS[element]).tobytes())
    (folder / f"{name}.mhd").write_text(mhd.format_header(mhd.header_of(meta or ImageMeta(a.shape[::-1]), f"{name}.raw", element)))
    return f"{folder}/{name}.mhd"


def test_from_files_to_files(spark, tmp_path):
    """A configuration, two images and a mask in; matrix, record, validation table, header and resampled image out."""
    p, n = np.array([1.2, -0.7, 0.5, 0.0, 0.0, 0.0]), 20
    f = ImageMeta((n, n, n), (1.0, 1.0, 1.0), (3.0, -2.0, 5.0))
    still, moved = phantom(n), phantom(n, p)
    keep = np.ones((n, n, n), int)
    keep[:, :, :2] = 0
    (tmp_path / "run.ini").write_text(f"""[DEFAULT]
fixed_image_name = {_write(tmp_path, "fixed", still, meta=f)}
moving_image_name = {_write(tmp_path, "moving", moved, meta=f)}
fixed_mask_image_name = {_write(tmp_path, "mask", keep, "MET_UCHAR", f)}
moving_mask_image_name = None
working_directory_name = {tmp_path}/work
output_directory_name = {tmp_path}/out
reuse_existing_input_images = True
patient_id = patient_007
modality_combination = a_to_b
fixed_modality = mr
moving_modality = CT
[compression]
fixed_image_bits_per_pixel = 10
moving_image_bits_per_pixel = 10
[masking]
fixed_grey_masking_range = 0 5000
moving_grey_masking_range = None
fixed_used_gradient_magnitude_fraction = 0.5
moving_used_gradient_magnitude_fraction = 0.5
[transformation]
transformation_type = rigid
store_as_RAS = True
[levenberg_marquardt]
max_nr_of_iterations = 8
[output]
resample_moving_image = True
store_RIRE_validation_file = True
RIRE_header = Patient ${{RIRE_patient_number}} from ${{RIRE_from}} to ${{RIRE_to}}
""")
    result, files = run.run(spark, f"{tmp_path}/run.ini")
    assert optimise.corner_shift(f, result.matrix, matrix_from_p(p), f) < 0.2
    assert np.allclose(export.swap_handedness(export.read_matrix(open(files["result.mat"]).read())), result.matrix)
    assert "transformation_type = rigid" in open(files["result.ini"]).read() and '"levels"' in open(files["result.json"]).read()
    lines = open(files["RIRE_patient_007_a_to_b.transformation"]).read().split("\n")
    assert lines[0] == "Patient 007 from MR to CT" and lines[1] == "" and lines[2].startswith("  1       3.0000    -2.0000     5.0000") and len(lines) == 14
    assert lines[-4:] == ["", "(All distances are in millimeters.)", "-" * 73, ""]
    meta, rows = mhd.read_mhd(spark, files["resampled_moving_image.mhd"])
    got = array(rows.withColumnRenamed("g", "v"), still.shape)
    inner = (slice(4, -4),) * 3
    assert meta == f and mhd.read_header(files["resampled_moving_image.mhd"])["ElementType"] == "MET_USHORT" and np.abs(got - still)[inner].mean() < 25
    head = mhd.read_header(files["moved_header.mhd"])
    assert head["ElementDataFile"] == f"{tmp_path}/moving.raw" and np.allclose(mhd.meta_of(head).offset, np.array(f.offset) - result.p[:3], atol=0.3)
    assert store.stored(spark, f"{tmp_path}/work", "fixed_pyramid").levels == store.stored(spark, f"{tmp_path}/work", "fixed_mask_pyramid").levels
    again = run.import_images(spark, run.read_job((tmp_path / "run.ini").read_text().replace("/fixed.mhd", "/gone.mhd")))
    assert set(again) == {"fixed", "moving", "fixed_mask"} and again["fixed"][0] == f
    with pytest.raises(ValueError, match="no image"):
        run.read_job("[DEFAULT]\nfixed_image_name = a.mhd")


def test_masks_are_moved_by_the_share_of_two_fifths(spark):
    a = (np.random.default_rng(2).random((6, 7, 8)) < 0.5).astype(int)
    for d in (0.25, 0.5, 0.75):
        m = np.eye(4)
        m[0, 3] = d
        got = array(resample.transform_block(table(spark, np.ones_like(a)), table(spark, a), a.shape[::-1], m, mask=True), a.shape)
        right = np.concatenate([a[:, :, 1:], a[:, :, -2:-1]], 2)  # mirrored at the last voxel
        want = ((1 - d) * a + d * right > 0.4).astype(int)
        if d >= 0.5:
            want[:, :, -1] = 0  # outside
        assert (got == want).all()


@pytest.mark.parametrize("most", [1 << 21, 200])
def test_resampling_by_chunks_is_that_by_voxels(spark, most):
    """Mirrored, linear and mask output, integers and floats, with a shear and parts outside; boxes of any size."""
    rng = np.random.default_rng(7)
    a, grid = rng.integers(0, 900, (13, 11, 17)), ImageMeta((14, 9, 12))
    m = np.array([[0.9375, 0.25, 0.0, -1.25], [-0.125, 1.125, 0.0625, 0.5], [0.0, -0.0625, 1.25, -0.375], [0, 0, 0, 1]])
    shape, rows = a.shape[::-1], table(spark, a)
    whole, cells = grid.shape[::-1], table(spark, np.ones(grid.shape[::-1], int))
    chunks = chunked(rows, ImageMeta(shape), 0, 5)
    for mask in (False, True):
        image = table(spark, (a > 450).astype(int)) if mask else rows
        want = array(resample.transform_block(cells, image, shape, m, mask), whole)
        made = resample.transform_chunks(grid, chunked(image, ImageMeta(shape), 0, 5), m, mask, most=most)
        assert made.count() == want.size and (array(made, whole) == want).all() and want.any()
    for limits in ((0, 500), None):
        want = {(r.z, r.y, r.x): r.v for r in resample.resample_linear(cells, rows, shape, m, limits).collect()}
        got = {(r.z, r.y, r.x): r.v for r in resample.linear_chunks(grid, chunks if limits else chunked(rows, ImageMeta(shape), 0, 5, "<f8"), m, limits, most=most).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    far = np.eye(4)
    far[0, 3] = 500
    assert array(resample.transform_chunks(grid, chunks, far), whole).sum() == 0
    plan = resample.linear_chunks(grid, chunks, m)._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan and plan.count("CartesianProduct") == plan.count("NestedLoop") == 0


def test_arrays_as_text_and_back(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([1.0, -2.5, 1e-9],), ([],), (None,)], "a array<double>").withColumn("t", pointwise.array_text(F.col("a")))
    back = [r.b for r in rows.withColumn("b", pointwise.text_array(F.col("t"))).collect()]
    assert rows.first().t == "1.0 -2.5 1.0E-9" and back[0] == [1.0, -2.5, 1e-9] and back[2] is None


def _runs_of(line):
    """Voxel by voxel."""
    out, start = [], None
    for i, v in enumerate([*line, 1]):
        if v > 0:
            if start is not None and i - start > runs.SHORTEST:
                out.append((start, i - start))
            start = None
        elif start is None and v == 0 and i + 1 < len(line) and line[i + 1] == 0:
            start = i
    return out


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_runs_over_pieces(spark, size):
    """Runs that begin, end and go on at pieces' ends, slices of background alone, and of none."""
    rng = np.random.default_rng(6)
    a = np.where(rng.random((6, 20, 50)) < 0.02, rng.integers(-9, 9, (6, 20, 50)), 0)
    a[1], a[2] = 0, 5
    a[3].flat[::2] = -1
    a[4].flat[: 7 * 64] = 1
    got = sorted((r.z, r.start, r.length) for r in runs.background_runs(table(spark, a), (50, 20, 6), size).collect())
    assert got == [(z, s, n) for z in range(6) for s, n in _runs_of(a[z].ravel())] and len(got) > 20
    back = {r.z: (r.pairs, r.differing) for r in runs.round_trip(table(spark, a), (50, 20, 6), size).collect()}
    assert back == {z: (len(_runs_of(a[z].ravel())), 0) for z in range(6)}


def test_quantile_digit_by_digit(spark):
    rng = np.random.default_rng(2)
    for n, bits in ((1, 20), (50, 20), (3000, 7), (3000, 20)):
        bins = rng.integers(0, 1 << bits, n)
        rows = spark.createDataFrame([(int(b), int(c)) for b, c in zip(*np.unique(bins, return_counts=True), strict=True)], "bin int, count long")
        for fraction in (0.0, 0.37, 0.9, 1.0):
            want = int(np.floor(n * fraction + 0.5))
            assert statistics.first_reached(rows, fraction, bits) == np.sort(bins)[max(0, want - 1)]
    assert statistics.first_reached(rows.limit(0), 0.5, 20) is None


def test_runs_round_trip():
    rng = np.random.default_rng(1)
    for length in (31, 32, 33, 34, 5000, 40_000):
        line = np.concatenate([[5], np.zeros(length), [7, 0, 3], rng.integers(-9, 9, 50), np.zeros(100)]).astype(np.int16)
        packed = runs.encode(line)
        assert (runs.decode(packed) == line).all() and (packed[1] <= -runs.MARK) == (length > 32)


def test_mhd_round_trip(spark, tmp_path, small):
    meta = ImageMeta((11, 10, 9), (0.1, 1 / 3, 2.0), (1.0, -2.0, 1e-9), tuple(rotation_matrix([0.1, 0.2, 0.3]).ravel()))
    path = f"{tmp_path}/a.mhd"
    mhd.write_mhd(table(spark, small).where("z <> 5"), meta, path, slab_bytes=500)
    back, rows = mhd.read_mhd(spark, path, slab_bytes=300)
    want = small.copy()
    want[5] = 0
    assert back == meta and (array(rows.withColumnRenamed("g", "v"), small.shape) == want).all() and rows.rdd.getNumPartitions() == 9


def test_a_crop_reads_the_bytes_of_its_box_alone(spark, tmp_path, small, monkeypatch):
    """Whole numbers stay whole, and one table serves many filters."""
    from pyspark.sql import functions as F

    meta, path = ImageMeta((11, 10, 9), (1.0, 2.0, 3.0)), f"{tmp_path}/a.mhd"
    mhd.write_mhd(table(spark, small), meta, path)
    _, rows = mhd.read_mhd(spark, path, slab_bytes=300)
    assert dict(rows.dtypes)["g"] == "bigint" and rows.where("z = 4 and x > 3").count() == 70 and rows.agg(F.sum("g")).first()[0] == small.sum()
    for offset, size in (((4, 4, 2), (5, 3, 3)), ((0, 2, 0), (11, 4, 9)), ((0, 0, 0), (11, 10, 9))):
        part, box = mhd.read_box(spark, path, offset, size, slab_bytes=300)
        (x, y, z), (nx, ny, nz) = offset, size
        assert part == meta.part(offset, size) and (array(box.withColumnRenamed("g", "v"), size[::-1]) == small[z : z + nz, y : y + ny, x : x + nx]).all()
    with pytest.raises(ValueError, match="within"):
        mhd.read_box(spark, path, (4, 4, 2), (8, 3, 3))
    reader, count = mhd.MhdReader(path, 300, "8 5 2 3 1 3"), []

    class Counted:
        def __init__(self, f):
            self.f, self.seek = f, f.seek

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n):
            count.append(n)
            return self.f.read(n)

    class Store:
        def open_input_file(self, at):
            return Counted(open(at, "rb"))

    monkeypatch.setattr(mhd, "_store", lambda p: (Store(), p))
    assert sum(b.num_rows for s in reader.partitions() for b in reader.read(s)) == 3 * 3 and sum(count) == 2 * 3 * 3


def test_writers_commit_all_or_nothing(spark, tmp_path, small):
    """Rows in any order; a failed task leaves no file; an image is replaced only by a finished one."""
    meta, path = ImageMeta((11, 10, 9)), f"{tmp_path}/out/a.mhd"
    spark.dataSource.register(mhd.MhdDataSource)
    write = lambda df, element="MET_SHORT": df.repartition(5, "x").write.format("mhd").mode("append").option("meta", mhd.meta_text(meta)).option("element", element).save(path)
    with pytest.raises(Exception, match="outside MET_UCHAR"):
        write(table(spark, small), "MET_UCHAR")
    assert not list((tmp_path / "out").iterdir())
    write(table(spark, small))
    with pytest.raises(Exception, match="outside the image"):
        write(table(spark, np.ones((10, 2, 2), int)))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.mhd", "a.raw"]
    back, rows = mhd.read_mhd(spark, path)
    assert back == meta and (array(rows.withColumnRenamed("g", "v"), small.shape) == small).all()
    write(table(spark, small + 1))
    assert array(mhd.read_mhd(spark, path)[1].withColumnRenamed("g", "v"), small.shape).sum() == small.sum() + small.size
    with pytest.raises(Exception, match="mounted"):
        mhd.MhdDataSource({"path": "s3://bucket/a.mhd", "meta": "{}"}).writer(None, False)


@pytest.mark.parametrize("element", sorted(mhd.ELEMENTS))
def test_mhd_element_types_and_headers(spark, tmp_path, element):
    for big in (False, True):
        kind = np.dtype((">" if big else "<") + mhd.ELEMENTS[element])
        data = np.arange(24).reshape(2, 3, 4).astype(kind)
        (tmp_path / "a.raw").write_bytes(b"h" * 512 + data.tobytes())
        head = mhd.header_of(ImageMeta((4, 3, 2)), "a.raw", element) | {"BinaryDataByteOrderMSB": str(big), "HeaderSize": "-1"}
        (tmp_path / "a.mhd").write_text(mhd.format_header(head) + "Unknown = 1\n\n")
        _, rows = mhd.import_image(spark, f"{tmp_path}/a.mhd", bits=10)
        got = array(rows, (2, 3, 4))
        assert got.min() == 1 and got.max() == 1023 and (np.diff(got.ravel()) > 0).all()


def test_mhd_errors():
    head = mhd.parse_header("CompressedData = True")
    with pytest.raises(ValueError):
        mhd.checked("a.mhd", head)
    with pytest.raises(TypeError):
        mhd.checked("a.nii", mhd.parse_header(""))
    with pytest.raises(ValueError):
        mhd.checked("a.MHD", mhd.parse_header("ElementDataFile = LIST"))


def test_isq_header():
    words = [0] * 128
    words[11:14], words[14:17], words[17:23], words[127] = (10, 20, 30), (1000, 4000, 9000), (1, 2, 3, 4, 5, 6), 3
    head = isq.read_header(struct.pack("<128i", *words))
    assert head["spacing"] == (0.1, 0.2, 0.3) and head["offset"] == 2048
    made = isq.to_mhd(struct.pack("<128i", *words), "x.isq")
    assert made["DimSize"] == "10 20 30" and made["HeaderSize"] == "-1" and made["ISQ_max_data_value"] == "5" and made["ISQ_slice_1_pos_um"] == "3"
    with pytest.raises(ValueError):
        isq.read_header(b"short")
    assert mhd.parse_header(mhd.format_header(made))["ISQ_energy_V"] == "0"


def test_isq_source(spark, tmp_path):
    words, data = [0] * 128, np.arange(24).reshape(2, 3, 4).astype("<i2")
    words[11:14], words[14:17] = (4, 3, 2), (400, 600, 800)
    (tmp_path / "a.isq").write_bytes(struct.pack("<128i", *words) + data.tobytes())
    meta, rows = isq.read_isq(spark, f"{tmp_path}/a.isq", slab_bytes=20)
    assert meta.shape == (4, 3, 2) and np.allclose(meta.spacing, (0.1, 0.2, 0.4)) and (array(rows.withColumnRenamed("g", "v"), data.shape) == data).all()


def test_values_outside_the_element_type_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="outside MET_UCHAR"):
        mhd.write_mhd(table(spark, np.full((2, 2, 2), 256)), ImageMeta((2, 2, 2)), f"{tmp_path}/a.mhd", "MET_UCHAR")
