"""Background runs of image slices: their places, and the skip pairs of foreign payloads.

A slice is cut into pieces. Runs within a piece are found there; of its ends a piece tells what a run over several pieces needs: whether
it has a core voxel, and where background begins before the first and after the last one. Those states, a few numbers a piece, are
combined along the slice, so no row and no window holds the voxels of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARK = 1 << 14
UNIT = 1 << 15
SHORTEST = 32


PIECE = 1 << 14
ENDS = "z int, piece long, core boolean, first short, last short, head_start long, head_last long, tail_start long, tail_last long, starts array<long>, lasts array<long>"


def pieces(masked: DataFrame, shape: Sequence[int], size: int = PIECE) -> DataFrame:
    """z, piece and line (the values of at most `size` voxels of the slice, in order)."""
    pos = F.col("y").cast("long") * shape[0] + F.col("x")
    rows = masked.select("z", F.floor(pos / size).alias("piece"), F.struct((pos % size).alias("at"), F.col("v").cast("short").alias("v")).alias("p"))
    return rows.groupBy("z", "piece").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("line"))


def parts_of(line: np.ndarray, base: int) -> tuple[bool, int | None, int | None, int | None, int | None, list[int | None], list[int]]:
    """Whether there is a core voxel; the start and last voxel of the background before the first and after the last one; and those between.

    A start is the first of two zeros in a row; the background of a line without core voxels counts as that before the first.
    """
    core = np.flatnonzero(line > 0)
    twice = np.flatnonzero((line[:-1] == 0) & (line[1:] == 0))
    begin, end = np.append(-1, core) + 1, np.append(core, len(line))  # background from ... up to
    at = np.searchsorted(twice, begin)
    found = np.append(twice, len(line))[at]
    start = [base + int(f) if f < e - 1 else None for f, e in zip(found, end, strict=True)]
    last = [base + int(e) - 1 for e in end]
    filled = begin < end
    head = (start[0], last[0]) if filled[0] else (None, None)
    if not len(core):
        return False, *head, None, None, [], []
    tail = (start[-1], last[-1]) if filled[-1] else (None, None)
    inner = [i for i in range(1, len(core)) if filled[i] and start[i] is not None]
    return True, *head, *tail, [start[i] for i in inner], [last[i] for i in inner]


def _ends(cut: DataFrame, size: int) -> DataFrame:
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int16(), pa.int16(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in ENDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for z, piece, values in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                line = np.array(values, np.int16)
                rows.append((z, piece, (own := parts_of(line, piece * size))[0], int(line[0]), int(line[-1]), *own[1:]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return cut.mapInArrow(run, ENDS)


def _runs(cut: DataFrame, size: int) -> DataFrame:
    ends = _ends(cut, size)
    along = Window.partitionBy("z").orderBy("piece")
    cores = F.coalesce(F.sum(F.col("core").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("group", cores).withColumn("joins", (F.col("last") == 0) & (F.lead("first").over(along) == 0))
    # two zeros in a row where pieces meet are a start too
    meet = F.when(F.col("joins"), (F.col("piece") + 1) * size - 1)
    open_end = lambda start, last: F.when(F.col(last).isNotNull(), F.least(start, meet))
    head = ends.select("z", "group", F.when(F.col("core"), F.col("head_start")).otherwise(open_end("head_start", "head_last")).alias("start"), F.col("head_last").alias("last"))
    tail = ends.where("core").select("z", (F.col("group") + 1).alias("group"), open_end("tail_start", "tail_last").alias("start"), F.col("tail_last").alias("last"))
    over = head.union(tail).groupBy("z", "group").agg(F.min("start").alias("start"), F.max("last").alias("last")).select("z", "start", "last")
    within = ends.select("z", F.explode(F.arrays_zip("starts", "lasts")).alias("r")).select("z", F.col("r.starts").alias("start"), F.col("r.lasts").alias("last"))
    length = F.col("last") - F.col("start") + 1
    return over.union(within).where(length > SHORTEST).where(length < UNIT * (UNIT - MARK)).select("z", "start", length.alias("length"))


def background_runs(masked: DataFrame, shape: Sequence[int], size: int = PIECE) -> DataFrame:
    """z, start and length of each run worth skipping: from two zeros in a row up to the next core voxel of the slice."""
    return _runs(pieces(masked, shape, size), size)


def encode(line: np.ndarray) -> np.ndarray:
    """The slice with a skip pair over the first two zeros of each run."""
    out, i, n = line.copy(), 0, len(line)
    zero = np.flatnonzero((line[:-1] == 0) & (line[1:] == 0))
    core = np.append(np.flatnonzero(line > 0), n)
    while True:
        k = np.searchsorted(zero, i)
        if k == len(zero):
            return out
        start = int(zero[k])
        stop = int(core[np.searchsorted(core, start)])
        if SHORTEST < stop - start < UNIT * (UNIT - MARK):
            out[start], out[start + 1] = -((stop - start) // UNIT + MARK), -((stop - start) % UNIT)
        i = stop


def decode(line: np.ndarray) -> np.ndarray:
    """Skip pairs become zeros again."""
    out = line.copy()
    at = np.flatnonzero(line <= -MARK)
    out[at] = 0
    out[np.minimum(at + 1, len(line) - 1)] = 0
    return out


def round_trip(masked: DataFrame, shape: Sequence[int], size: int = PIECE) -> DataFrame:
    """z, pairs written and voxels that differ after decoding, for each slice; both are done piece by piece.

    A run's pair goes to the pieces of its two first voxels; in decoding, a piece needs to know whether the one before it ends with a mark.
    """
    cut = pieces(masked, shape, size)
    runs = _runs(cut, size)
    code = F.array(-(F.floor(F.col("length") / UNIT) + MARK), -(F.col("length") % UNIT))
    marks = runs.select("z", F.posexplode(code).alias("k", "code"), "start").select("z", F.floor((F.col("start") + F.col("k")) / size).alias("piece"), F.struct(((F.col("start") + F.col("k")) % size).alias("at"), F.col("code").cast("short").alias("code"), (F.col("k") == 0).alias("first")).alias("m"))
    both = cut.join(marks.groupBy("z", "piece").agg(F.collect_list("m").alias("marks")), ["z", "piece"], "left").select("z", "piece", "line", "marks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for line, marks in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                v = np.array(line, np.int16)
                for m in marks or ():
                    v[m["at"]] = m["code"]
                packed.append(v)
            pairs = [sum(m["first"] for m in marks or ()) for marks in b.column(3).to_pylist()]
            columns = [pa.array([v.tobytes() for v in packed], pa.binary()), pa.array([bool(v[-1] <= -MARK) for v in packed]), pa.array(pairs, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["z", "piece", "line", "packed", "open", "pairs"])

    written = both.mapInArrow(write, "z int, piece long, line array<short>, packed binary, open boolean, pairs long")
    after = F.coalesce(F.lag("open").over(Window.partitionBy("z").orderBy("piece")), F.lit(False))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differing = []
            for line, packed, after in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                v = decode(np.frombuffer(packed, np.int16))
                if after:
                    v[0] = 0
                differing.append(int((v != np.array(line, np.int16)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), pa.array(differing, pa.int64())], ["z", "pairs", "differing"])

    rows = written.select(F.col("z").cast("long").alias("z"), "line", "packed", after.alias("after"), "pairs").mapInArrow(read, "z long, pairs long, differing long")
    return rows.groupBy("z").agg(F.sum("pairs").alias("pairs"), F.sum("differing").alias("differing"))
