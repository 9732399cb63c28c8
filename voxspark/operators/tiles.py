"""Tiles of one image's grid, each with the box of another image that a transform takes it to.

Which chunks of the other image a box meets follows from the tile's place and the transform, so tiles and chunks are
joined by arithmetic: an equal join on chunk coordinates. Chunks give only what a box needs of them, and boxes are put
together by tile, in one exchange of those parts. A tile whose box would be too large is cut in eighths first, so
under any transform a task holds a box of a stated size.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX_VOXELS = 1 << 21  #: most voxels of a box, except where the tile is one voxel
PIECE_BYTES = 1 << 20  #: of blocks that a task gathers before it hands them on
FEW_PAIRS = 200_000  #: pairs of a tile and a chunk, some 100 bytes each, that are broadcast; they are counted

TILE = ["pose", "z0", "y0", "x0", "nz", "ny", "nx"]
BOX = ["bz", "by", "bx", "sz", "sy", "sx"]
_INTS = "pose int, z0 int, y0 int, x0 int, nz int, ny int, nx int, bz int, by int, bx int, sz int, sy int, sx int"


def buffers(column: pa.Array) -> Iterator[pa.Buffer | None]:
    """The binary values of a batch one by one, so that a task copies a block at a time: a batch may be as large as Spark lets it be."""
    for value in column:
        yield value.as_buffer() if value.is_valid else None


def transformed_points(matrix: np.ndarray, x, y, z) -> list[np.ndarray]:
    """The three coordinates, added up in the order in which the relational forms do."""
    return [r[0] * x + r[1] * y + r[2] * z + r[3] for r in np.asarray(matrix, float)[:3]]


def box_of(first: np.ndarray, size: np.ndarray, matrix: np.ndarray, shape: np.ndarray, rim: int, margin: int) -> tuple[np.ndarray, np.ndarray] | None:
    """First voxel and size (z, y, x) of the box that the tile with a rim, and `margin` voxels beyond, may need; None outside the image."""
    x, y, z = (np.array([first[k] - rim, first[k] + size[k] - 1 + rim], float)[[(i >> j) & 1 for i in range(8)]] for j, k in enumerate((2, 1, 0)))
    at = np.stack(transformed_points(matrix, x, y, z)[::-1])
    low = np.maximum(np.floor(at.min(1)).astype(np.int64) - margin, 0)
    high = np.minimum(np.floor(at.max(1)).astype(np.int64) + 1 + margin, shape - 1)
    return (low, high - low + 1) if (high >= low).all() else None


def split(first: np.ndarray, size: np.ndarray, matrix: np.ndarray, shape: np.ndarray, rim: int, margin: int, most: int, empty: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The tile and its box, or those of its eighths where the box has more than `most` voxels; tiles without a box are left out, or have one of no size with `empty`."""
    if (box := box_of(first, size, matrix, shape, rim, margin)) is None:
        if empty:
            yield first, size, np.zeros(3, np.int64), np.zeros(3, np.int64)
        return
    if box[1].prod() <= most or (size == 1).all():
        yield first, size, *box
        return
    halves = [[(0, n)] if n == 1 else [(0, (n + 1) // 2), ((n + 1) // 2, n)] for n in size]
    for part in itertools.product(*halves):
        yield from split(first + [a for a, _ in part], np.array([b - a for a, b in part]), matrix, shape, rim, margin, most, empty)


def planned(rows: DataFrame, edge: int, grid: Sequence[int], poses: Sequence[np.ndarray], shape: Sequence[int], rim: int, margin: int, most: int, halo: int | None = None, kind: str = "<i2", empty: bool = False, planes: int = 1) -> DataFrame:
    """Tiles and boxes, by arithmetic, for the chunks cz, cy, cx of a grid (sizes x, y, z) under every pose (voxel matrices).

    With `halo`, also `block`: the tile's own voxels with that rim, from the chunks' data, which are `planes` values a voxel, one after the other.
    """
    own, other = np.array(grid[::-1]), np.array(shape[::-1])
    names = [c.split()[0] for c in _INTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j, place in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)):
                first = np.array(place) * edge
                size = np.minimum(edge, own - first)
                made = [(k, *x) for k, m in enumerate(poses) for x in split(first, size, m, other, rim, margin, most, empty)]
                columns = [pa.array([int(v) for v in c], pa.int32()) for c in zip(*[(k, *f, *s, *low, *n) for k, f, s, low, n in made], strict=True)] if made else [pa.array([], pa.int32())] * 13
                if halo is not None:
                    side = edge + 2 * halo
                    data = np.frombuffer(b.column(3)[j].as_py(), kind).reshape(planes, side, side, side)
                    cut = [data[(slice(None), *(slice(a, a + n + 2 * halo) for a, n in zip(f - first, s, strict=True)))].tobytes() for _, f, s, *_ in made]
                    columns.append(pa.array(cut, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "block"][: len(columns)])

    if halo is None:
        return rows.select("cz", "cy", "cx").mapInArrow(run, _INTS)
    return rows.select("cz", "cy", "cx", "data").mapInArrow(run, f"{_INTS}, block binary")


def pair_bound(edge: int, grid: Sequence[int], poses: Sequence[np.ndarray], shape: Sequence[int], rim: int, margin: int, most: int) -> int | None:
    """At most so many pairs of a tile and a chunk come of planned() with these arguments, by arithmetic; None where a tile may have to be cut."""
    chunks, pairs, other = int(np.prod([-(-n // edge) for n in grid])), 0, np.array(shape)
    for m in poses:
        span = np.abs(np.asarray(m, float)[:3, :3]) @ np.full(3, edge - 1.0 + 2 * rim) + 1e-6
        size = np.minimum(np.floor(span) + 3 + 2 * margin, other)
        if size.prod() > most:
            return None
        pairs += chunks * int(np.prod((size - 1) // edge + 2))
    return pairs


def boxed(tiles: DataFrame, chunks: DataFrame, edge: int, kind: np.dtype | str = np.int16, bound: int | None = None) -> DataFrame:
    """The parts of the boxes: the tiles' columns, with `at` (z, y, x of the part in its box), `n` (its size) and `part`, from chunks of edge^3 voxels without a rim.

    Pairs are broadcast where `bound`, which they cannot exceed, or else their count allows it.
    """
    span = lambda b, s: F.sequence(F.floor(F.col(b) / edge), F.floor((F.col(b) + F.col(s) - 1) / edge))
    pairs = tiles.where("sz > 0")
    for k in "zyx":
        pairs = pairs.withColumn(f"c{k}", F.explode(span(f"b{k}", f"s{k}")))
    few = bound is not None and bound <= FEW_PAIRS or pairs.count() <= FEW_PAIRS
    met = chunks.select("cz", "cy", "cx", "data").join(F.broadcast(pairs) if few else pairs, ["cz", "cy", "cx"])
    names = [c.split()[0] for c in _INTS.split(", ")]
    kind = np.dtype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], -1).astype(np.int64) * edge
            low = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(11, 14)], -1).astype(np.int64)
            size = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(14, 17)], -1).astype(np.int64)
            begin, end = np.maximum(low - place, 0), np.minimum(low + size - place, edge)
            at, n = place + begin - low, end - begin
            parts, done, held = [], 0, 0
            for j, (data, f, t) in enumerate(zip(buffers(b.column(3)), begin.tolist(), end.tolist(), strict=True)):
                block = np.frombuffer(data, kind).reshape(edge, edge, edge)
                parts.append(block[f[0] : t[0], f[1] : t[1], f[2] : t[2]].tobytes())
                held += len(parts[-1])
                if held >= PIECE_BYTES or j == b.num_rows - 1:
                    lists = [pa.array(x[done : j + 1].tolist(), pa.list_(pa.int32())) for x in (at, n)]
                    ints = [c.slice(done, j + 1 - done) for c in b.columns[4:]]
                    yield pa.RecordBatch.from_arrays([*ints, *lists, pa.array(parts, pa.binary())], [*names, "at", "n", "part"])
                    parts, done, held = [], j + 1, 0

    return met.select("cz", "cy", "cx", "data", *names).mapInArrow(run, f"{_INTS}, at array<int>, n array<int>, part binary")


def assembled(parts: pd.DataFrame, kind: np.dtype | str = np.int16) -> tuple[np.ndarray, np.ndarray]:
    """First voxel (z, y, x) and voxels of one tile's box; where no chunk was, 0."""
    r = parts.iloc[0]
    box = np.zeros((r.sz, r.sy, r.sx), kind)
    for at, n, part in zip(parts["at"], parts["n"], parts["part"], strict=True):
        box[tuple(slice(a, a + k) for a, k in zip(at, n, strict=True))] = np.frombuffer(part, kind).reshape(tuple(n))
    return np.array([r.bz, r.by, r.bx]), box


# --- interpolation --------------------------------------------------------------------------------


def corner_sum(box: np.ndarray, first: np.ndarray, points: Sequence[np.ndarray], index: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Trilinear values at the points (x, y, z coordinates) from the eight voxels around each; `index(axis, i)` changes voxel coordinates first."""
    base = [np.floor(p).astype(np.int64) for p in points]
    d = [p - b for p, b in zip(points, base, strict=True)]
    out = np.zeros(len(points[0]))
    for i in range(8):
        o = [(i >> j) & 1 for j in range(3)]
        w = 1.0
        for j in range(3):
            w = w * (d[j] if o[j] else 1 - d[j])
        c = [b + k for b, k in zip(base, o, strict=True)]
        if index is not None:
            c = [index(j, x) for j, x in enumerate(c)]
        out += w * box[c[2] - first[0], c[1] - first[1], c[0] - first[2]]
    return out


def mirrored_values(box: np.ndarray, first: np.ndarray, points: Sequence[np.ndarray], shape: Sequence[int]) -> np.ndarray:
    """Values inside the image's outer faces, mirrored at the outermost voxels; NaN outside."""
    out = np.full(len(points[0]), np.nan)
    inside = np.logical_and.reduce([(p >= -0.5) & (p < n - 0.5) for p, n in zip(points, shape, strict=True)])
    index = lambda j, c: np.where(c < 0, 1, np.where(c >= shape[j], shape[j] - 2, c))
    out[inside] = corner_sum(box, first, [p[inside] for p in points], index)
    return out


def linear_values(box: np.ndarray, first: np.ndarray, points: Sequence[np.ndarray], shape: Sequence[int]) -> np.ndarray:
    """Values within the outermost voxel centres; NaN outside."""
    out = np.full(len(points[0]), np.nan)
    inside = np.logical_and.reduce([(p >= 0) & (p <= n - 1) for p, n in zip(points, shape, strict=True)])
    index = lambda j, c: np.minimum(c, shape[j] - 1)  # noqa: E731  # a corner beyond has no weight
    out[inside] = corner_sum(box, first, [p[inside] for p in points], index)
    return out
