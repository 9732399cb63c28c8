"""Registered queries of the voxel operators and the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import ImageMeta, matrix_from_p, rotation_matrix
from ..operators import average, blocks, lcc, pointwise, resample, runs, statistics, stencil
from ..sources import mhd, store, volumes
from ..sources.volumes import fixed_volume, moving_volume, raw_volume, volume_meta
from . import masking, optimise, pyramid
from .register import Config, register

FRACTION = 0.1
CROP = ((5, 4, 3), (20, 10, 8))
SKIP = (2, 3, 2)
OBLIQUE = ImageMeta((64, 25, 20), (0.5, 1.25, 2.0), (-16.0, 8.0, 4.0), (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0))
#: Entries are sums of powers of two, so that every product is exact in either engine.
MATRIX = np.array([[0.9375, 0.125, 0.0, 1.25], [-0.125, 0.9375, 0.0625, 0.5], [0.0, -0.0625, 1.0, 0.375], [0, 0, 0, 1]])
DIGITS = 9
SHIFTS = [(2.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.5, 0.25, -0.25), (3.0, 0.0, 0.0), (2.0, 1.0, 0.0), (2.0, 0.0, -1.0)]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shift(t: tuple[float, float, float]) -> np.ndarray:
    return matrix_from_p([*t, 0, 0, 0])


def images(spark: SparkSession, sf_dir: str) -> tuple[ImageMeta, DataFrame, DataFrame]:
    fixed = fixed_volume(spark, sf_dir)
    return volume_meta(spark, sf_dir), fixed, moving_volume(fixed)


def masked_images(spark: SparkSession, sf_dir: str) -> tuple[ImageMeta, DataFrame, DataFrame]:
    meta, fixed, moving = images(spark, sf_dir)
    return meta, masking.mask_image(fixed, meta, FRACTION, False), masking.mask_image(moving, meta, FRACTION, True)


@contextlib.contextmanager
def freed(*kept: lcc.Chunks | DataFrame):
    """Kept tables, given back when the driver has its numbers."""
    try:
        yield
    finally:
        for x in kept:
            (x if isinstance(x, DataFrame) else x.rows).unpersist()


def masked_pair(spark: SparkSession, sf_dir: str, slopes: bool = False) -> tuple[ImageMeta, lcc.Chunks, lcc.Chunks]:
    """Both masks by chunks, made once; with `slopes` for derivatives of the fixed one."""
    meta, fixed, moving = images(spark, sf_dir)
    return meta, blocks.masked_chunks(fixed, meta, FRACTION, False, slopes=slopes), blocks.masked_chunks(moving, meta, FRACTION, True)


# --- SQL parts ----------------------------------------------------------------------------------

G = """g AS (SELECT CAST(vec_id // 25 AS INTEGER) AS z, CAST(vec_id % 25 AS INTEGER) AS y, CAST(i AS INTEGER) AS x, CAST(e AS DOUBLE) AS g
  FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings))"""
VOX = f"""{G}, r AS (SELECT min(g) AS lo, max(g) AS hi FROM g),
fix AS (SELECT z, y, x, CAST(CASE WHEN g <= lo THEN 1 WHEN g >= hi THEN 1023 ELSE floor((g - lo) / (hi - lo) * 1022e0 + 1 + 0.5e0 + 2.22e-15) END AS INTEGER) AS v FROM g, r),
d AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM fix),
mov AS (SELECT a.z, a.y, a.x, CAST(greatest(1, b.v + (7 * a.x + 13 * a.y + 29 * a.z) % 5) AS INTEGER) AS v
  FROM fix a JOIN fix b ON a.z = b.z AND a.y = b.y AND b.x = greatest(0, a.x - 2))"""


def _gm(name: str) -> str:
    """gm_<name>: interior gradient magnitudes; lim_<name>: its threshold."""
    return f"""w_{name} AS (SELECT z, y, x, v,
    lead(v) OVER (PARTITION BY z, y ORDER BY x) - lag(v) OVER (PARTITION BY z, y ORDER BY x) AS dx,
    lead(v) OVER (PARTITION BY z, x ORDER BY y) - lag(v) OVER (PARTITION BY z, x ORDER BY y) AS dy,
    lead(v) OVER (PARTITION BY y, x ORDER BY z) - lag(v) OVER (PARTITION BY y, x ORDER BY z) AS dz FROM {name}),
gm_{name} AS (SELECT z, y, x, v, CAST(dx * dx + dy * dy + dz * dz AS BIGINT) AS gm FROM w_{name}, d
  WHERE x BETWEEN 1 AND nx - 2 AND y BETWEEN 1 AND ny - 2 AND z BETWEEN 1 AND nz - 2),
top_{name} AS (SELECT max(gm) AS top FROM gm_{name}),
h_{name} AS (SELECT CAST(least(floor(gm / CAST(top AS DOUBLE) * 1048576e0 + 0.5e0 + 2.22e-15), 1048575) AS INTEGER) AS bin, count(*) AS count
  FROM gm_{name}, top_{name} GROUP BY 1),
c_{name} AS (SELECT bin, sum(count) OVER (ORDER BY bin) AS s, sum(count) OVER () AS n FROM h_{name}),
lim_{name} AS (SELECT CAST(min(bin) AS INTEGER) AS bin, any_value(top) * min(bin) / 1048576e0 AS lim FROM c_{name}, top_{name} WHERE s >= floor(n * (1 - {FRACTION}e0) + 0.5e0))"""


def _masked(name: str, near: str) -> str:
    return f"""core_{name} AS (SELECT z, y, x FROM gm_{name}, lim_{name} WHERE gm > lim),
near_{name} AS (SELECT DISTINCT c.z + a AS z, c.y + b AS y, c.x + c AS x FROM core_{name} c,
  (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b), (SELECT unnest(range(-2, 3)) AS c) WHERE {near}),
m_{name} AS (SELECT i.z, i.y, i.x, CAST(CASE WHEN k.z IS NOT NULL THEN i.v WHEN n.z IS NOT NULL THEN -i.v ELSE 0 END AS INTEGER) AS v
  FROM {name} i LEFT JOIN core_{name} k USING (z, y, x) LEFT JOIN near_{name} n USING (z, y, x))"""


FIX_MASK = f"{VOX}, {_gm('fix')}, {_masked('fix', 'abs(a) + abs(b) + abs(c) <= 2')}"
BOTH_MASKS = f"{FIX_MASK}, {_gm('mov')}, {_masked('mov', 'true')}"
CORNERS = """(SELECT unnest([0, 1]) AS ox), (SELECT unnest([0, 1]) AS oy), (SELECT unnest([0, 1]) AS oz)"""
WEIGHT = "(CASE WHEN ox = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE WHEN oy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN oz = 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END)"
INNER = "px >= 0.5e0 AND px < nx - 1.5e0 AND py >= 0.5e0 AND py < ny - 1.5e0 AND pz >= 0.5e0 AND pz < nz - 1.5e0"
INTERP = f"""q AS (SELECT p.*, CAST(floor(px) AS INTEGER) + ox AS cx, CAST(floor(py) AS INTEGER) + oy AS cy, CAST(floor(pz) AS INTEGER) + oz AS cz, {WEIGHT} AS w
  FROM p, d, {CORNERS} WHERE {INNER}),
t AS (SELECT q.k, q.z, q.y, q.x, q.v, CASE WHEN max(m.v) > 0 THEN sum(w * abs(m.v)) ELSE -sum(w * abs(m.v)) END AS t
  FROM q JOIN m_mov m ON m.x = cx AND m.y = cy AND m.z = cz WHERE m.v <> 0 GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 8)"""
LCC = f"""{INTERP},
e AS (SELECT k, z + a AS z, y + b AS y, x + c AS x, CAST(abs(v) AS DOUBLE) AS b, abs(t) AS t, a = 0 AND b = 0 AND c = 0 AND v > 0 AND t > 0 AS own
  FROM t, (VALUES (0,0,0), (-1,0,0), (1,0,0), (0,-1,0), (0,1,0), (0,0,-1), (0,0,1)) o(a, b, c)),
s AS (SELECT k, sum(b * b) - sum(b) * sum(b) / 7 AS bb, sum(t * t) - sum(t) * sum(t) / 7 AS tt, sum(b * t) - sum(b) * sum(t) / 7 AS bt
  FROM e, d WHERE x BETWEEN 2 AND nx - 3 AND y BETWEEN 2 AND ny - 3 AND z BETWEEN 2 AND nz - 3
  GROUP BY k, z, y, x HAVING count(*) = 7 AND bool_or(own) AND min(t) >= 1)"""


def _points(shifts) -> str:
    """p: fixed voxels of the mask with their places under each shift."""
    rows = ", ".join(f"({i}, {a}e0, {b}e0, {c}e0)" for i, (a, b, c) in enumerate(shifts))
    return f"p AS (SELECT k, f.z, f.y, f.x, f.v, f.x + tx AS px, f.y + ty AS py, f.z + tz AS pz FROM m_fix f, (VALUES {rows}) s(k, tx, ty, tz) WHERE f.v <> 0)"


def _affine_sql(m: np.ndarray, source=("x", "y", "z"), to=("px", "py", "pz")) -> str:
    return ", ".join(f"{float(r[0])!r}::DOUBLE * {source[0]} + {float(r[1])!r}::DOUBLE * {source[1]} + {float(r[2])!r}::DOUBLE * {source[2]} + {float(r[3])!r}::DOUBLE AS {t}" for r, t in zip(m[:3], to, strict=True))


def _down_sql(source: str, to: tuple[str, str, str], mask: bool = False) -> str:
    axes = ""
    for k, n, m in (("x", "nx", to[0]), ("y", "ny", to[1]), ("z", "nz", to[2])):
        axes += f"a{k} AS (SELECT i, o, least((o + 1) * {n}, (i + 1) * {m}) - greatest(o * {n}, i * {m}) AS w FROM d, (SELECT unnest(range(0, {n})) AS i FROM d), (SELECT unnest(range(0, {m})) AS o FROM d) WHERE least((o + 1) * {n}, (i + 1) * {m}) > greatest(o * {n}, i * {m})), "
    value = "CASE WHEN 4 * s > nx * ny * nz THEN 1 ELSE 0 END" if mask else "(2 * s + nx * ny * nz) // (2 * nx * ny * nz)"
    return f"""{axes}u AS (SELECT az.o AS z, ay.o AS y, ax.o AS x, CAST(sum(CAST(ax.w * ay.w * az.w AS BIGINT) * v) AS BIGINT) AS s
  FROM {source} i JOIN ax ON ax.i = i.x JOIN ay ON ay.i = i.y JOIN az ON az.i = i.z GROUP BY 1, 2, 3)
SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST({value} AS INTEGER) AS v FROM u, d"""


def _half(n: str, factor: str) -> str:
    return f"CAST(round_even({n} / {factor}, 0) AS BIGINT)"


# --- queries ------------------------------------------------------------------------------------


@query(f"WITH {G} SELECT min(g) AS low, max(g) AS high FROM g")
def value_range(spark, sf_dir):
    return pointwise.value_range(raw_volume(spark, sf_dir), "g")


@query(f"WITH {VOX} SELECT * FROM fix")
def voxelize_rescale(spark, sf_dir):
    return fixed_volume(spark, sf_dir)


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN v > 512 THEN 1 ELSE 0 END AS v FROM fix")
def mask_binarize(spark, sf_dir):
    return pointwise.binarize(fixed_volume(spark, sf_dir).withColumn("v", F.when(F.col("v") > 512, F.col("v")).otherwise(0)))


@query(f"WITH {VOX} SELECT z - 3 AS z, y - 4 AS y, x - 5 AS x, v FROM fix WHERE x BETWEEN 5 AND 24 AND y BETWEEN 4 AND 13 AND z BETWEEN 3 AND 10")
def crop_part(spark, sf_dir):
    return pointwise.crop(fixed_volume(spark, sf_dir), *CROP)


@query(f"WITH {VOX} SELECT z // 2 AS z, y // 3 AS y, x // 2 AS x, v FROM fix WHERE x % 2 = 0 AND y % 3 = 0 AND z % 2 = 0")
def stride_reduce(spark, sf_dir):
    return pointwise.strided(fixed_volume(spark, sf_dir), SKIP)


def _diff_sql(e: str) -> str:
    return f"WITH {VOX} SELECT z, y, x, {e} AS v FROM fix a JOIN mov b USING (z, y, x)"


@query(_diff_sql("a.v - b.v"))
def diff_signed(spark, sf_dir):
    _, a, b = images(spark, sf_dir)
    return pointwise.difference(a, b)


@query(_diff_sql("abs(a.v - b.v)"))
def diff_abs(spark, sf_dir):
    _, a, b = images(spark, sf_dir)
    return pointwise.difference(a, b, absolute=True)


@query(_diff_sql("((a.v % 256 - b.v % 256) + 256) % 256"))
def diff_abs_wrap_u8(spark, sf_dir):
    _, a, b = images(spark, sf_dir)
    low = lambda d: d.withColumn("v", F.col("v") % 256)
    return pointwise.difference(low(a), low(b), wrap_bits=8)


@query(f"WITH {VOX} SELECT z, y, x, v, {_affine_sql(OBLIQUE.voxel_to_world, to=('wx', 'wy', 'wz'))} FROM fix")
def voxel_to_world(spark, sf_dir):
    return pointwise.transformed(fixed_volume(spark, sf_dir), OBLIQUE.voxel_to_world, to=("wx", "wy", "wz"))


@query(f"WITH {VOX} SELECT z, y, x, v, {_affine_sql(OBLIQUE.world_to_voxel, to=('vx', 'vy', 'vz'))} FROM fix")
def world_to_voxel(spark, sf_dir):
    return pointwise.transformed(fixed_volume(spark, sf_dir), OBLIQUE.world_to_voxel, to=("vx", "vy", "vz"))


@query(f"WITH {VOX}, {_gm('fix')} SELECT z, y, x, v, gm FROM gm_fix")
def gradient_magnitude(spark, sf_dir):
    meta, fixed, _ = images(spark, sf_dir)
    return stencil.gradient_magnitude(fixed, meta.shape)


@query(f"WITH {VOX}, {_gm('fix')} SELECT g.z, g.y, g.x, g.v, CASE WHEN g.v > 512 THEN gm ELSE 0 END AS gm FROM gm_fix g")
def masked_gradient(spark, sf_dir):
    meta, fixed, _ = images(spark, sf_dir)
    return stencil.gradient_magnitude(fixed, meta.shape, mask=fixed.withColumn("v", (F.col("v") > 512).cast("int")))


@query(f"WITH {VOX}, {_gm('fix')} SELECT max(gm) AS top FROM gm_fix")
def gm_max(spark, sf_dir):
    meta, fixed, _ = images(spark, sf_dir)
    return stencil.gradient_magnitude(fixed, meta.shape).agg(F.max("gm").alias("top"))


@query(f"WITH {VOX}, {_gm('fix')} SELECT bin, count FROM h_fix")
def gm_histogram(spark, sf_dir):
    meta, fixed, _ = images(spark, sf_dir)
    g = stencil.gradient_magnitude(fixed, meta.shape)
    return statistics.gradient_histogram(g, statistics.gradient_max(g))


@query(f"WITH {VOX}, {_gm('mov')} SELECT bin, lim AS \"limit\" FROM lim_mov")
def gm_threshold(spark, sf_dir):
    meta, _, moving = images(spark, sf_dir)
    g = stencil.gradient_magnitude(moving, meta.shape)
    top = statistics.gradient_max(g)
    return statistics.gradient_threshold(statistics.gradient_histogram(g, top), top, FRACTION)


@query(f"WITH {FIX_MASK} SELECT * FROM m_fix")
def edge_mask_fixed(spark, sf_dir):
    return masked_images(spark, sf_dir)[1]


@query(f"WITH {BOTH_MASKS} SELECT * FROM m_mov")
def edge_mask_moving(spark, sf_dir):
    return masked_images(spark, sf_dir)[2]


@query(f"WITH {FIX_MASK} SELECT z, y, x, abs(v) AS v FROM m_fix")
def abs_export(spark, sf_dir):
    return pointwise.magnitude(masked_images(spark, sf_dir)[1])


@query(f"WITH {FIX_MASK} SELECT count(*) FILTER (v > 0) AS n_core, count(*) FILTER (v < 0) AS n_context, count(*) FILTER (v = 0) AS n_background, CAST(sum(v) AS BIGINT) AS sum_v FROM m_fix")
def mask_stats(spark, sf_dir):
    return statistics.mask_stats(masked_images(spark, sf_dir)[1])


def _down(spark, sf_dir, factor: float, mask: bool = False) -> DataFrame:
    meta, fixed, _ = images(spark, sf_dir)
    image = fixed.withColumn("v", (F.col("v") > 512).cast("int")) if mask else fixed
    return resample.downsample(image, meta.shape, resample.resampled_shape(meta.shape, (factor,) * 3), mask)


TWO = tuple(_half(n, "2e0") for n in ("nx", "ny", "nz"))
ROOT = tuple(_half(n, "sqrt(2e0)") for n in ("nx", "ny", "nz"))


@query(f"WITH {VOX}, {_down_sql('fix', TWO)}")
def downsample_2(spark, sf_dir):
    return _down(spark, sf_dir, 2.0)


@query(f"WITH {VOX}, {_down_sql('fix', ROOT)}")
def downsample_sqrt2(spark, sf_dir):
    return _down(spark, sf_dir, math.sqrt(2))


@query(f"WITH {VOX}, b AS (SELECT z, y, x, CASE WHEN v > 512 THEN 1 ELSE 0 END AS v FROM fix), {_down_sql('b', TWO, True)}")
def downsample_mask(spark, sf_dir):
    return _down(spark, sf_dir, 2.0, True)


def _down_chunked(spark, sf_dir, factor: float, mask: bool = False) -> DataFrame:
    meta, fixed, _ = images(spark, sf_dir)
    image = fixed.withColumn("v", (F.col("v") > 512).cast("int")) if mask else fixed
    return blocks.voxels(average.averaged(lcc.chunked(image, meta, 0), meta.resampled(resample.resampled_shape(meta.shape, (factor,) * 3)), mask))


@query(SQL["downsample_2"])
def downsample_2_chunked(spark, sf_dir):
    """By prefix sums of chunks; grey values are 1 or more, so no voxel is left out."""
    return _down_chunked(spark, sf_dir, 2.0)


@query(SQL["downsample_sqrt2"])
def downsample_sqrt2_chunked(spark, sf_dir):
    return _down_chunked(spark, sf_dir, math.sqrt(2))


@query(f"SELECT * FROM ({SQL['downsample_mask']}) WHERE v <> 0")
def downsample_mask_chunked(spark, sf_dir):
    return _down_chunked(spark, sf_dir, 2.0, True)


@query(f"""WITH {VOX}, n AS (SELECT *, greatest(0, least(CAST(trunc(ln(nx * ny * nz / 1000e0) / ln(2e0) / 3 + 0.5e0) AS INTEGER),
    CAST(trunc(ln(least(nx, ny, nz) / 7e0) / ln(2e0)) AS INTEGER))) AS last FROM d),
l AS (SELECT unnest(range(0, last + 1)) AS level, nx, ny, nz FROM n),
o AS (SELECT level, {", ".join(f"CASE WHEN level = 0 THEN {n} WHEN level = 1 THEN {_half(n, '2e0')} WHEN level = 2 THEN {_half(_half(n, '2e0'), '2e0')} ELSE {_half(_half(_half(n, '2e0'), '2e0'), '2e0')} END AS {n}" for n in ("nx", "ny", "nz"))} FROM l)
SELECT CAST(level AS INTEGER) AS level, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny, CAST(nz AS BIGINT) AS nz FROM o""")
def pyramid_levels(spark, sf_dir):
    """Sizes of the levels, as counted from the voxels of each."""
    meta, fixed, _ = images(spark, sf_dir)
    out = None
    for i, level in enumerate(pyramid.build_pyramid(fixed, meta, pyramid.plan_pyramid([meta]))):
        row = blocks.voxels(level).agg(F.lit(i).alias("level"), *[(F.max(k) + 1).cast("long").alias(f"n{k}") for k in ("x", "y", "z")])
        out = row if out is None else out.union(row)
    return out


@query(f"""WITH {VOX}, p AS (SELECT z, y, x, {_affine_sql(MATRIX)} FROM fix),
q AS (SELECT p.*, CAST(floor(px) AS INTEGER) + ox AS cx, CAST(floor(py) AS INTEGER) + oy AS cy, CAST(floor(pz) AS INTEGER) + oz AS cz, {WEIGHT} AS w FROM p, d, {CORNERS}
  WHERE px >= -0.5e0 AND px < nx - 0.5e0 AND py >= -0.5e0 AND py < ny - 0.5e0 AND pz >= -0.5e0 AND pz < nz - 0.5e0),
c AS (SELECT q.z, q.y, q.x, w, CASE WHEN cx < 0 THEN 1 WHEN cx >= nx THEN nx - 2 ELSE cx END AS cx, CASE WHEN cy < 0 THEN 1 WHEN cy >= ny THEN ny - 2 ELSE cy END AS cy,
  CASE WHEN cz < 0 THEN 1 WHEN cz >= nz THEN nz - 2 ELSE cz END AS cz FROM q, d)
SELECT c.z, c.y, c.x, sum(w * m.v) AS t FROM c JOIN mov m ON m.x = cx AND m.y = cy AND m.z = cz GROUP BY 1, 2, 3""")
def interp_mirrored(spark, sf_dir):
    meta, fixed, moving = images(spark, sf_dir)
    return resample.interpolate_mirrored(pointwise.transformed(fixed, MATRIX), moving, meta.shape, ["z", "y", "x"])


@query(f"WITH {BOTH_MASKS}, p AS (SELECT 0 AS k, z, y, x, v, {_affine_sql(MATRIX)} FROM fix), {INTERP} SELECT z, y, x, t FROM t")
def interp_masked(spark, sf_dir):
    meta, _, moving = masked_pair(spark, sf_dir)
    return resample.interpolate_masked(pointwise.transformed(fixed_volume(spark, sf_dir), MATRIX), blocks.voxels(moving), meta.shape, ["z", "y", "x"])


@query(SQL["interp_mirrored"].replace("SELECT c.z, c.y, c.x, sum(w * m.v) AS t FROM", ", t AS (SELECT c.z, c.y, c.x, sum(w * m.v) AS t FROM").rstrip()
       + ") SELECT f.z, f.y, f.x, CAST(coalesce(floor(t + 0.5e0 + 2.22e-15), 0) AS INTEGER) AS v FROM fix f LEFT JOIN t USING (z, y, x)")
def transform_block(spark, sf_dir):
    meta, fixed, moving = images(spark, sf_dir)
    return resample.transform_block(fixed, moving, meta.shape, MATRIX)


@query(f"""WITH {VOX}, p AS (SELECT z, y, x, {_affine_sql(MATRIX)} FROM fix),
q AS (SELECT p.*, CAST(floor(px) AS INTEGER) + ox AS cx, CAST(floor(py) AS INTEGER) + oy AS cy, CAST(floor(pz) AS INTEGER) + oz AS cz, {WEIGHT} AS w FROM p, d, {CORNERS}
  WHERE px BETWEEN 0 AND nx - 1 AND py BETWEEN 0 AND ny - 1 AND pz BETWEEN 0 AND nz - 1),
t AS (SELECT q.z, q.y, q.x, sum(w * m.v) AS t FROM q JOIN mov m ON m.x = cx AND m.y = cy AND m.z = cz WHERE w > 0 GROUP BY 1, 2, 3)
SELECT f.z, f.y, f.x, CAST(coalesce(floor(t + 0.5e0 + 2.22e-15), 0) AS INTEGER) AS v FROM fix f LEFT JOIN t USING (z, y, x)""")
def resample_linear(spark, sf_dir):
    meta, fixed, moving = images(spark, sf_dir)
    return resample.resample_linear(fixed, moving, meta.shape, MATRIX)


@query(SQL["transform_block"])
def transform_block_chunked(spark, sf_dir):
    """The same by chunks: blocks of the moving image go to the tiles of the grid that need them."""
    meta, fixed, moving = images(spark, sf_dir)
    return resample.transform_chunks(lcc.chunked(fixed, meta, 0), lcc.chunked(moving, meta, 0), MATRIX)


@query(SQL["transform_block"].replace("JOIN mov m ON", "JOIN bin m ON").replace(", p AS (", ", bin AS (SELECT z, y, x, CASE WHEN v > 512 THEN 1 ELSE 0 END AS v FROM mov), p AS (", 1)
       .replace("CAST(coalesce(floor(t + 0.5e0 + 2.22e-15), 0) AS INTEGER) AS v", "CASE WHEN t > 0.4e0 THEN 1 ELSE 0 END AS v"))
def transform_mask_chunked(spark, sf_dir):
    meta, fixed, moving = images(spark, sf_dir)
    return resample.transform_chunks(lcc.chunked(fixed, meta, 0), lcc.chunked(moving.withColumn("v", (F.col("v") > 512).cast("int")), meta, 0), MATRIX, mask=True)


@query(SQL["resample_linear"])
def resample_linear_chunked(spark, sf_dir):
    meta, fixed, moving = images(spark, sf_dir)
    return resample.linear_chunks(lcc.chunked(fixed, meta, 0), lcc.chunked(moving, meta, 0), MATRIX)


@query(f"""WITH {FIX_MASK}, p AS (SELECT {_affine_sql(OBLIQUE.voxel_to_world)} FROM m_fix, d WHERE v > 0 AND x BETWEEN 1 AND nx - 2 AND y BETWEEN 1 AND ny - 2 AND z BETWEEN 1 AND nz - 2)
SELECT count(*) AS n, sum(px) AS sx, sum(py) AS sy, sum(pz) AS sz, sum(py*py+pz*pz) AS ixx, sum(px*px+pz*pz) AS iyy, sum(px*px+py*py) AS izz, sum(-px*py) AS ixy, sum(-px*pz) AS ixz, sum(-py*pz) AS iyz FROM p""")
def edge_moments(spark, sf_dir):
    meta, fixed, _ = masked_pair(spark, sf_dir)
    return statistics.edge_moment_sums(blocks.voxels(fixed), meta.shape, OBLIQUE.voxel_to_world)


@query(f"WITH {BOTH_MASKS}, {_points(SHIFTS[2:3])}, {LCC} SELECT count(*) AS n, round(avg(1 - bt * bt / (bb * tt)), {DIGITS}) AS lcc FROM s WHERE bb * tt > 1e-20")
def lcc_value(spark, sf_dir):
    meta, fixed, moving = masked_pair(spark, sf_dir)
    return lcc.lcc_value(blocks.voxels(fixed), blocks.voxels(moving), meta.shape, meta.shape, shift(SHIFTS[2])).withColumn("lcc", F.round("lcc", DIGITS))


@query(f"WITH {BOTH_MASKS}, {_points(SHIFTS)}, {LCC} SELECT k AS candidate, count(*) AS n, round(avg(1 - bt * bt / (bb * tt)), {DIGITS}) AS lcc FROM s WHERE bb * tt > 1e-20 GROUP BY k")
def lcc_candidates(spark, sf_dir):
    """In one job over tiles and their boxes, which are not kept."""
    _, fixed, moving = masked_pair(spark, sf_dir)
    return lcc.lcc_candidates(fixed, moving, [shift(t) for t in SHIFTS]).withColumn("lcc", F.round("lcc", DIGITS))


@query(SQL["lcc_candidates"])
def lcc_candidates_chunked(spark, sf_dir):
    """The same on kept tiles, as the steps of a registration do it."""
    _, fixed, moving = masked_pair(spark, sf_dir)
    with freed(fixed, moving):
        return _similarities(spark, lcc.evaluate(fixed, moving, [np.array([*t, 0, 0, 0]) for t in SHIFTS]))


#: A pass of the descent: twelve moves about oblique axes through a centre of the fixed image, after an initial transform and a first move.
PASS = optimise.descent_moves(
    matrix_from_p([1.5, 0.25, -0.25, 0.01, 0.0, 0.02]), matrix_from_p([0.25, 0, 0, 0, 0.01, 0]), np.array([30.0, 12.0, 9.0]), rotation_matrix([0.3, -0.2, 0.5]), 1.0, 0.02,
)[1]


def _places(ps) -> str:
    """p: fixed voxels of the mask with their places under each transform."""
    each = " UNION ALL ".join(f"SELECT {i} AS k, z, y, x, v, {_affine_sql(matrix_from_p(p))} FROM m_fix WHERE v <> 0" for i, p in enumerate(ps))
    return f"p AS ({each})"


@query(f"WITH {BOTH_MASKS}, {_places(PASS)}, {LCC} SELECT k AS candidate, count(*) AS n, round(avg(1 - bt * bt / (bb * tt)), {DIGITS}) AS lcc FROM s WHERE bb * tt > 1e-20 GROUP BY k")
def descent_pass(spark, sf_dir):
    """The similarity of the twelve moves of a pass, in one job on kept tiles."""
    _, fixed, moving = masked_pair(spark, sf_dir)
    with freed(fixed, moving):
        return _similarities(spark, lcc.evaluate(fixed, moving, PASS, margin=4))


def _similarities(spark, got) -> DataFrame:
    return spark.createDataFrame([(i, s.n, round(s.lcc, DIGITS)) for i, s in enumerate(got) if s.n], "candidate int, n long, lcc double")


DERIVED = (1.75, 0.125, 0.0)


def _derivatives_sql(terms: list[str], digits: tuple[int, int]) -> str:
    """n, lcc, gradient and upper half of the Gauss-Newton matrix for the derivatives `terms` of the fixed image (gradient gx, gy, gz at t.x, t.y, t.z)."""
    ks, at = range(len(terms)), "OVER (PARTITION BY cz, cy, cx)"
    upper = [(i, j) for i in ks for j in range(i, len(terms))]
    return f"""WITH {BOTH_MASKS}, {_points([DERIVED])}, {INTERP},
cd AS (SELECT z, y, x, v, (lead(v) OVER (PARTITION BY z, y ORDER BY x) - lag(v) OVER (PARTITION BY z, y ORDER BY x)) * 0.5e0 AS gx,
  (lead(v) OVER (PARTITION BY z, x ORDER BY y) - lag(v) OVER (PARTITION BY z, x ORDER BY y)) * 0.5e0 AS gy,
  (lead(v) OVER (PARTITION BY y, x ORDER BY z) - lag(v) OVER (PARTITION BY y, x ORDER BY z)) * 0.5e0 AS gz FROM fix),
pts AS (SELECT t.z + a AS cz, t.y + b AS cy, t.x + c AS cx, abs(t.t) AS b, CAST(cd.v AS DOUBLE) AS t, {", ".join(f"{e} AS d{k}" for k, e in enumerate(terms))},
  a = 0 AND b = 0 AND c = 0 AND t.v > 0 AND t.t > 0 AS own
  FROM t JOIN cd USING (z, y, x), (VALUES (0,0,0), (-1,0,0), (1,0,0), (0,-1,0), (0,1,0), (0,0,-1), (0,0,1)) o(a, b, c)),
cen AS (SELECT cz, cy, cx, b - avg(b) {at} AS b, t - avg(t) {at} AS t, {", ".join(f"d{k} - avg(d{k}) {at} AS d{k}" for k in ks)},
  count(*) {at} AS k, bool_or(own) {at} AS own, min(b) {at} AS least FROM pts),
sums AS (SELECT *, sum(b * b) {at} AS bb, sum(t * t) {at} AS tt, sum(b * t) {at} AS bt, {", ".join(f"sum(t * d{k}) {at} AS td{k}, sum(b * d{k}) {at} AS bd{k}" for k in ks)}
  FROM cen, d WHERE k = 7 AND own AND least >= 1 AND cx BETWEEN 2 AND nx - 3 AND cy BETWEEN 2 AND ny - 3 AND cz BETWEEN 2 AND nz - 3),
left_over AS (SELECT 2 / bb AS c, b - bt / tt * t AS m, {", ".join(f"2 * bt * td{k} * t / (tt * tt) - (bd{k} * t + bt * d{k}) / tt AS m{k}" for k in ks)} FROM sums WHERE bb >= 1e-20 AND tt >= 1e-20)
SELECT CAST(count(*) // 7 AS BIGINT) AS n, round(sum(c * m * m) / 2 / (count(*) / 7), {DIGITS}) AS lcc, {", ".join(f"round(sum(c * m * m{k}) / (count(*) / 7), {digits[0]}) AS g{k}" for k in ks)},
  {", ".join(f"round(sum(c * m{i} * m{j}) / (count(*) / 7), {digits[1]}) AS h{i}_{j}" for i, j in upper)} FROM left_over"""


def _derivatives(spark, sf_dir, p: np.ndarray, digits: tuple[int, int]) -> DataFrame:
    _, fixed, moving = masked_pair(spark, sf_dir, slopes=True)
    with freed(fixed, moving):
        s, ks = lcc.evaluate(fixed, moving, [p], True)[0], range(len(p))
    rounded = lambda v, n: round(float(v), n) if s.n else None  # noqa: E731  # without overlap there is nothing to round
    g, h = (s.gradient, s.hessian) if s.n else (np.zeros(len(p)), np.zeros((len(p), len(p))))
    row = {"lcc": rounded(s.lcc, DIGITS)} | {f"g{k}": rounded(g[k], digits[0]) for k in ks} | {f"h{i}_{j}": rounded(h[i, j], digits[1]) for i in ks for j in range(i, len(p))}
    return spark.createDataFrame([(s.n, *row.values())], "n long, " + ", ".join(f"{c} double" for c in row))


@query(_derivatives_sql(["gx", "gy", "gz", "t.y * gz - t.z * gy", "t.z * gx - t.x * gz", "t.x * gy - t.y * gx"], (6, 4)))
def lcc_derivatives(spark, sf_dir):
    """Similarity, rigid gradient and Gauss-Newton matrix near the minimum."""
    return _derivatives(spark, sf_dir, np.array([*DERIVED, 0, 0, 0]), (6, 4))


@query(_derivatives_sql([f"{g} * {w}" for g in ("gx", "gy", "gz") for w in ("t.x", "t.y", "t.z", "1")], (4, 2)))
def lcc_derivatives_affine(spark, sf_dir):
    """The same for the twelve parameters of an affine transform."""
    m = np.eye(4)
    m[:3, 3] = DERIVED
    return _derivatives(spark, sf_dir, m[:3].ravel(), (4, 2))


@query(f"""WITH {FIX_MASK}, l AS (SELECT z, CAST(y AS BIGINT) * nx + x AS pos, v FROM m_fix, d),
w AS (SELECT *, lead(v) OVER (PARTITION BY z ORDER BY pos) AS nxt, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY z ORDER BY pos) AS part FROM l),
s AS (SELECT z, part, min(CASE WHEN v = 0 AND nxt = 0 THEN pos END) AS start, max(pos) AS last FROM w WHERE v <= 0 GROUP BY z, part)
SELECT z, start, last - start + 1 AS length FROM s WHERE last - start + 1 > 32""")
def rle_runs(spark, sf_dir):
    meta, fixed, _ = masked_images(spark, sf_dir)
    return runs.background_runs(fixed, meta.shape)


@query(SQL["rle_runs"].replace("SELECT z, start, last - start + 1 AS length FROM s WHERE last - start + 1 > 32", "SELECT CAST(l.z AS BIGINT) AS z, CAST(coalesce(any_value(r.pairs), 0) AS BIGINT) AS pairs, CAST(0 AS BIGINT) AS differing FROM l LEFT JOIN (SELECT z, count(*) AS pairs FROM s WHERE last - start + 1 > 32 GROUP BY z) r ON r.z = l.z GROUP BY l.z"))
def rle_roundtrip(spark, sf_dir):
    meta, fixed, _ = masked_images(spark, sf_dir)
    return runs.round_trip(fixed, meta.shape)


@query(f"""WITH {VOX}, c AS (SELECT CAST(1 + i AS INTEGER) AS corner, CAST((i % 2) * (nx - 1) AS DOUBLE) AS x, CAST((i // 2 % 2) * (ny - 1) AS DOUBLE) AS y, CAST((i // 4) * (nz - 1) AS DOUBLE) AS z
  FROM d, (SELECT unnest(range(0, 8)) AS i)) SELECT corner, x, y, z, {_affine_sql(MATRIX, to=("tx", "ty", "tz"))} FROM c""")
def rire_corners(spark, sf_dir):
    """The eight corners of the fixed image and where a transform takes them."""
    _, fixed, _ = images(spark, sf_dir)
    ends = fixed.agg(*[F.max(k).cast("double").alias(f"n{k}") for k in "xyz"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    at = ends.select((F.col("i") + 1).alias("corner"), *[(F.shiftright("i", s) % 2 * F.col(f"n{k}")).cast("double").alias(k) for s, k in enumerate("xyz")])
    return pointwise.transformed(at, MATRIX, to=("tx", "ty", "tz"))


SMOOTH = f"""{VOX}, sx AS (SELECT z, y, x, sum(v) OVER w AS s, count(*) OVER w AS n FROM fix WINDOW w AS (PARTITION BY z, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
sy AS (SELECT z, y, x, sum(s) OVER w AS s, sum(n) OVER w AS n FROM sx WINDOW w AS (PARTITION BY z, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
sz AS (SELECT z, y, x, sum(s) OVER w AS s, sum(n) OVER w AS n FROM sy WINDOW w AS (PARTITION BY y, x ORDER BY z RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
sm AS (SELECT z, y, x, CAST(s AS DOUBLE) / CAST(n AS DOUBLE) AS g FROM sz), sr AS (SELECT min(g) AS slo, max(g) AS shi FROM sm),
smooth AS (SELECT z, y, x, CAST(CASE WHEN g <= slo THEN 1 WHEN g >= shi THEN 1023 ELSE floor((g - slo) / (shi - slo) * 1022e0 + 1 + 0.5e0 + 2.22e-15) END AS INTEGER) AS v FROM sm, sr)"""
BOX = "x BETWEEN 8 AND 55 AND y BETWEEN 4 AND 20 AND z BETWEEN 3 AND 16"


@query(f"WITH {SMOOTH} SELECT * FROM smooth")
def smooth_volume(spark, sf_dir):
    return volumes.smooth_volume(fixed_volume(spark, sf_dir))


@query(f"WITH {SMOOTH} SELECT a.z, a.y, a.x, b.v FROM smooth a JOIN smooth b ON a.z = b.z AND b.y = greatest(0, a.y - 1) AND b.x = greatest(0, a.x - 2)")
def shifted_volume(spark, sf_dir):
    return volumes.shifted(volumes.smooth_volume(fixed_volume(spark, sf_dir)), 2, 1)


@query(SQL["edge_mask_fixed"] + " WHERE v <> 0")
def edge_mask_chunked_fixed(spark, sf_dir):
    """The same by chunks, unpacked."""
    meta, fixed, _ = images(spark, sf_dir)
    return blocks.voxels(blocks.masked_chunks(fixed, meta, FRACTION, False))


@query(SQL["edge_mask_moving"] + " WHERE v <> 0")
def edge_mask_chunked_moving(spark, sf_dir):
    meta, _, moving = images(spark, sf_dir)
    return blocks.voxels(blocks.masked_chunks(moving, meta, FRACTION, True))


@query(f"WITH {VOX}, {_gm('fix').replace('AS BIGINT) AS gm FROM w_fix, d', f'AS BIGINT) * CAST({BOX} AS BIGINT) AS gm FROM w_fix, d')}, {_masked('fix', 'abs(a) + abs(b) + abs(c) <= 2')} SELECT * FROM m_fix")
def edge_mask_with_mask(spark, sf_dir):
    """Edges only where a mask image is not 0."""
    meta, fixed, _ = images(spark, sf_dir)
    return masking.mask_image(fixed, meta, FRACTION, False, box_mask(fixed))


@query(SQL["edge_mask_with_mask"] + " WHERE v <> 0")
def edge_mask_with_mask_chunked(spark, sf_dir):
    meta, fixed, _ = images(spark, sf_dir)
    return blocks.voxels(blocks.masked_chunks(fixed, meta, FRACTION, False, box_mask(fixed)))


def box_mask(image: DataFrame) -> DataFrame:
    return image.select("z", "y", "x", F.expr(f"cast({BOX} as int)").alias("v"))


def smooth_pair(spark: SparkSession, sf_dir: str) -> tuple[ImageMeta, DataFrame, DataFrame, DataFrame]:
    """A smooth image, the same two voxels on along x and one along y, and the kept table that both are made of."""
    mean = volumes.cube_mean(fixed := fixed_volume(spark, sf_dir)).persist()
    smooth = volumes.smooth_volume(fixed, mean)
    return volume_meta(spark, sf_dir), smooth, volumes.shifted(smooth, 2, 1), mean


def _pose(spark, p, digits: int = 2) -> DataFrame:
    """The parameters, rounded; SQL has those that the images were made with."""
    return spark.createDataFrame([tuple(round(float(x), digits) + 0.0 for x in p)], ", ".join(f"p{i} double" for i in range(len(p))))


def _planted(p) -> str:
    return "SELECT " + ", ".join(f"{float(x)!r}::DOUBLE AS p{i}" for i, x in enumerate(p)) + " FROM (SELECT count(*) FROM embeddings)"


@query(_planted((2, 1, 0, 0, 0, 0)))
def register_rigid(spark, sf_dir):
    """From identity, with the default configuration: the whole pyramid, descent by moves, then damped Gauss-Newton steps."""
    meta, fixed, moving, kept = smooth_pair(spark, sf_dir)
    with freed(kept):
        return _pose(spark, register(fixed, meta, moving, meta, Config()).p)


@query(_planted((1, 0, 0, 2, 0, 1, 0, 1, 0, 0, 1, 0)))
def register_affine(spark, sf_dir):
    meta, fixed, moving, kept = smooth_pair(spark, sf_dir)
    with freed(kept):
        return _pose(spark, register(fixed, meta, moving, meta, Config(affine=True)).p)


@query(_planted((2, 1, 0, 0, 0, 0)))
def register_masked(spark, sf_dir):
    """Edges of both images only inside a box."""
    meta, fixed, moving, kept = smooth_pair(spark, sf_dir)
    mask = (meta, box_mask(fixed))
    with freed(kept):
        return _pose(spark, register(fixed, meta, moving, meta, Config(), fixed_mask=mask, moving_mask=mask).p)


@query(_planted((24, 0, 0, 0, 0, 1.57)))
def moments_init(spark, sf_dir):
    """The pose of an image turned by a quarter, from the moments of its edges: all 24 proper rotations of the axes are tried."""
    meta, fixed, _, kept = smooth_pair(spark, sf_dir)
    nx, ny, nz = meta.shape
    around = replace(meta, shape=(ny, nx, nz))
    fc, mc = blocks.masked_chunks(fixed, meta, FRACTION, False), blocks.masked_chunks(volumes.turned(fixed, ny), around, FRACTION, True)
    with freed(kept, fc, mc):
        return _pose(spark, optimise.transform_from_moments(fc, mc).p)


def _scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: a new one in spark.checkpoint.dir, or on one machine a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/') if root else tempfile.mkdtemp(prefix='spark-shared-')}/volume-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str) -> str:
    meta, fixed, _ = images(spark, sf_dir)
    path = f"{_scratch(spark)}/fixed.mhd"
    mhd.write_mhd(fixed, replace(meta, spacing=(0.5, 1.25, 2.0)), path)
    return path


@query(SQL["voxelize_rescale"].replace("SELECT * FROM fix", "SELECT z, y, x, CAST(v AS BIGINT) AS v FROM fix"))
def mhd_round_trip(spark, sf_dir):
    """The fixed volume written as a file by tasks and read again. A file has 0 where the table has no voxel; grey values are 1 or more."""
    return mhd.read_mhd(spark, _written(spark, sf_dir))[1].where("g <> 0").withColumnRenamed("g", "v")


@query(SQL["crop_part"].replace(", v FROM fix", ", CAST(v AS BIGINT) AS v FROM fix"))
def mhd_box(spark, sf_dir):
    """A box of the written file; only its own lines are read."""
    return mhd.read_box(spark, _written(spark, sf_dir), *CROP)[1].where("g <> 0").withColumnRenamed("g", "v")


@query(SQL["downsample_2"].replace("SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,", "SELECT CAST(z - 1 AS INTEGER) AS z, CAST(y - 2 AS INTEGER) AS y, CAST(x - 3 AS INTEGER) AS x,") + " WHERE x BETWEEN 3 AND 22 AND y BETWEEN 2 AND 8 AND z BETWEEN 1 AND 3")
def stored_level_box(spark, sf_dir):
    """A box of the second level of a pyramid that was stored and opened again."""
    meta, fixed, _ = images(spark, sf_dir)
    root = _scratch(spark)
    levels = [lcc.chunked(fixed, meta, 0)]
    levels.append(average.averaged(levels[0], meta.resampled(resample.resampled_shape(meta.shape, (2.0,) * 3))))
    store.save_pyramid(spark, root, "fixed", levels, volumes.BITS)
    return store.open_box(spark, root, "fixed", (3, 2, 1), (20, 7, 3), level=1)[1]
