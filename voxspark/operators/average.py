"""Area averages of chunked images by prefix sums.

Along an axis, n voxels become m: voxel i covers the parts i m ... (i + 1) m of n m, and an output cell n of them, so a running
sum of a chunk's voxels gives the sum of every cell that it meets, in whole numbers. Cells that lie in one chunk are finished
there; of those that a chunk's faces cut, the sums go to the cell's chunk and are added up.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from ..functions.geometry import ImageMeta
from .lcc import Chunks
from .tiles import buffers

PIECE = "cz long, cy long, cx long, at array<int>, n array<int>, done binary, cells array<int>, sums array<long>"


def axis_sums(a: np.ndarray, axis: int, first: int, n: int, m: int) -> tuple[int, np.ndarray, np.ndarray]:
    """First output cell, the cells' sums along the axis from voxels `first` on, and which cells lie within these voxels."""
    count = a.shape[axis]
    low, high = first * m // n, ((first + count) * m - 1) // n
    edges = np.arange(low, high + 2) * n
    at = np.clip(edges, first * m, (first + count) * m) - first * m
    own = np.moveaxis(a, axis, 0)
    zero = np.zeros((1, *own.shape[1:]), np.int64)
    before, own = np.concatenate([zero, np.cumsum(own, 0)]), np.concatenate([own, zero])
    whole, part = np.divmod(at, m)
    running = m * before[whole] + part.reshape(-1, 1, 1) * own[whole]
    return low, np.moveaxis(np.diff(running, axis=0), 0, axis), (edges[:-1] >= first * m) & (edges[1:] <= (first + count) * m)


def finished(sums: np.ndarray, den: int, mask: bool) -> np.ndarray:
    """The rounded mean; of a mask, whether it is above a quarter."""
    return (4 * sums > den if mask else (2 * sums + den) // (2 * den)).astype(np.int16)


def averaged(image: Chunks, to: ImageMeta, mask: bool = False) -> Chunks:
    """The area average with the geometry `to`, rounded half up; a mask is 1 where more than a quarter is.

    One exchange, of averages and of the sums of cut cells; sums of whole numbers are the same in any order.
    """
    shape, small, edge, kind = image.meta.shape, to.shape, image.edge, image.kind
    if any(m > n or m < 1 for n, m in zip(shape, small, strict=True)):
        raise ValueError(f"cannot average {tuple(shape)} to {tuple(small)}")
    den, sizes = int(np.prod([int(n) for n in shape])), list(zip(shape[::-1], small[::-1], strict=True))
    names = [c.split()[0] for c in PIECE.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, data in zip(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), buffers(b.column(3)), strict=True):
                first = [c * edge for c in place]
                a = np.frombuffer(data, kind).reshape(edge, edge, edge)[tuple(slice(n - f) for f, (n, _) in zip(first, sizes, strict=True))].astype(np.int64)
                lows, wholes = [], []
                for axis, (f, (n, m)) in enumerate(zip(first, sizes, strict=True)):
                    low, a, whole = axis_sums(a, axis, f, n, m)
                    lows.append(low)
                    wholes.append(whole)
                whole = wholes[0][:, None, None] & wholes[1][:, None] & wholes[2]
                done, rows = np.where(whole, finished(a, den, mask), 0).astype(np.int16), []
                spans = [range(low // edge, (low + k - 1) // edge + 1) for low, k in zip(lows, a.shape, strict=True)]
                for out in itertools.product(*spans):
                    at = [max(low - o * edge, 0) for low, o in zip(lows, out, strict=True)]
                    part = tuple(slice(o * edge + i - low, min((o + 1) * edge - low, k)) for o, i, low, k in zip(out, at, lows, a.shape, strict=True))
                    rest = np.argwhere(~whole[part])
                    cells = ((rest[:, 0] + at[0]) * edge + rest[:, 1] + at[1]) * edge + rest[:, 2] + at[2]
                    rows.append((*out, at, list(done[part].shape), done[part].tobytes(), cells.tolist(), a[part][tuple(rest.T)].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def put(group: pd.DataFrame) -> pd.DataFrame:
        out, sums, touched = np.zeros((edge,) * 3, np.int16), np.zeros(edge**3, np.int64), np.zeros(edge**3, bool)
        for at, n, done, cells, parts in zip(*(group[c] for c in names[3:]), strict=True):
            out[tuple(slice(a, a + k) for a, k in zip(at, n, strict=True))] |= np.frombuffer(done, np.int16).reshape(tuple(n))
            cells = np.asarray(cells, np.int64)
            np.add.at(sums, cells, np.asarray(parts, np.int64))
            touched[cells] = True
        flat = out.reshape(-1)
        flat[touched] = finished(sums[touched], den, mask)
        r = group.iloc[0]
        return pd.DataFrame({"cz": [r.cz], "cy": [r.cy], "cx": [r.cx], "n_core": [int((out > 0).sum())], "data": [out.tobytes()]})

    rows = image.rows.select("cz", "cy", "cx", "data").mapInArrow(cut, PIECE).groupBy("cz", "cy", "cx").applyInPandas(put, "cz long, cy long, cx long, n_core long, data binary")
    return Chunks(rows, to, 0, edge)

