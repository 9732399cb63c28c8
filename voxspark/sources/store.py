"""Images kept as chunks by level: `images` has a row of geometry and header an image, `chunks` its blocks, by image_id, level and zone.

A zone is a cube of ZONE^3 chunks in one folder, whose chunks lie along a space-filling curve, with each chunk's number of core voxels and
its least and largest value. So a box at a level reads the folders of its zones and, in their files, the row groups of its chunks.
Background chunks have no row; an image of zeros is its row in `images` alone. A pyramid is an image with several levels, a mask an image of 0 and 1
or, edge-masked, of signed values.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import ImageMeta
from ..operators.blocks import voxels
from ..operators.lcc import CHUNK, Chunks, chunked
from ..operators.pointwise import crop

IMAGES = "meta string, bits int, header map<string,string>, log array<string>, levels array<string>, edge int, halo int"
CHUNKS = "cz long, cy long, cx long, n_core long, data binary, least int, most int"
ZONE = 16
MOST_ZONES = 4096  #: zones that a box names; a larger box goes by the chunks' coordinates alone


@dataclass(frozen=True)
class Stored:
    meta: ImageMeta
    bits: int
    header: dict[str, str] = field(default_factory=dict)
    log: tuple[str, ...] = ()
    levels: tuple[ImageMeta, ...] = ()  #: below the base image
    edge: int = CHUNK
    halo: int = 0

    @property
    def lv_max(self) -> int:
        """The largest squared grey value."""
        return ((1 << self.bits) - 1) ** 2


def _row(root: str, image_id: str) -> str:
    return f"{root}/images/image_id={image_id}"


def _blocks(root: str, image_id: str, level: int) -> str:
    return f"{root}/chunks/image_id={image_id}/level={level}"


def _meta(text: str) -> ImageMeta:
    return ImageMeta(**{k: tuple(v) for k, v in json.loads(text).items()})


def create_image(spark: SparkSession, root: str, image_id: str, image: Stored) -> None:
    """An image of zeros: its row alone."""
    row = (json.dumps(asdict(image.meta)), image.bits, dict(image.header), list(image.log), [json.dumps(asdict(m)) for m in image.levels], image.edge, image.halo)
    spark.createDataFrame([row], IMAGES).coalesce(1).write.mode("overwrite").parquet(_row(root, image_id))


def empty_like(spark: SparkSession, root: str, template: str, image_id: str) -> None:
    """An image of zeros on another one's grid."""
    create_image(spark, root, image_id, stored(spark, root, template))


def curve(place: Sequence[Column], bits: int) -> Column:
    """The number of a chunk (z, y, x) along a space-filling curve: the bits of its coordinates in turn."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for j, c in enumerate(reversed(place)):
            out = out + F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(1), 3 * b + j)
    return out


def zone_of(place: Sequence[int | Column]):
    """Of a chunk's coordinates (z, y, x): three numbers of seven digits."""
    z, y, x = place
    return (z * 10_000_000 + y) * 10_000_000 + x if not isinstance(z, int) else (z * 10**7 + y) * 10**7 + x


def _with_limits(chunks: Chunks) -> DataFrame:
    kind, names = chunks.kind, [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [np.frombuffer(d, kind) for d in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([int(f(x)) for x in blocks], pa.int32()) for f in (np.min, np.max)]], names)

    return chunks.rows.select("cz", "cy", "cx", "n_core", "data").mapInArrow(run, CHUNKS)


def save_level(spark: SparkSession, root: str, image_id: str, level: int, chunks: Chunks) -> None:
    place = [F.col(c) for c in ("cz", "cy", "cx")]
    zone = zone_of([F.floor(c / ZONE) for c in place])
    rows = _with_limits(chunks).where("least <> 0 or most <> 0").withColumn("zone", zone).withColumn("_at", curve([F.pmod(c, F.lit(ZONE)) for c in place], ZONE.bit_length() - 1))
    rows.repartition("zone").sortWithinPartitions("zone", "_at").drop("_at").write.partitionBy("zone").mode("overwrite").parquet(_blocks(root, image_id, level))


def save_pyramid(spark: SparkSession, root: str, image_id: str, levels: Sequence[Chunks], bits: int, header: Mapping[str, str] | None = None, log: Sequence[str] = ()) -> None:
    """All levels, the finest first, then the row that makes them known."""
    for i, c in enumerate(levels):
        save_level(spark, root, image_id, i, c)
    first, *rest = [c.meta for c in levels]
    create_image(spark, root, image_id, Stored(first, bits, dict(header or {}), tuple(log), tuple(rest), levels[0].edge, levels[0].halo))


def save_image(spark: SparkSession, root: str, image_id: str, rows: DataFrame, meta: ImageMeta, bits: int, header: Mapping[str, str] | None = None, log: Sequence[str] = ()) -> None:
    """Of a voxel table."""
    save_pyramid(spark, root, image_id, [chunked(rows, meta, 0)], bits, header, log)


def stored(spark: SparkSession, root: str, image_id: str) -> Stored:
    r = spark.read.schema(IMAGES).parquet(_row(root, image_id)).first()
    return Stored(_meta(r.meta), r.bits, dict(r.header or {}), tuple(r.log or ()), tuple(map(_meta, r.levels)), r.edge, r.halo)


def open_level(spark: SparkSession, root: str, image_id: str, level: int = 0, image: Stored | None = None) -> Chunks:
    """The chunks of a level that are not all background."""
    image = image or stored(spark, root, image_id)
    try:
        rows = spark.read.schema(f"{CHUNKS}, zone long").parquet(_blocks(root, image_id, level))
    except AnalysisException:
        rows = spark.createDataFrame([], f"{CHUNKS}, zone long")
    return Chunks(rows, (image.meta, *image.levels)[level], image.halo, image.edge)


def open_pyramid(spark: SparkSession, root: str, image_id: str) -> list[Chunks]:
    image = stored(spark, root, image_id)
    return [open_level(spark, root, image_id, i, image) for i in range(1 + len(image.levels))]


def open_image(spark: SparkSession, root: str, image_id: str) -> tuple[ImageMeta, DataFrame]:
    """Geometry and the voxels that are not 0."""
    level = open_level(spark, root, image_id)
    return level.meta, voxels(level)


def part_of(chunks: Chunks, offset: Sequence[int], size: Sequence[int]) -> Chunks:
    """The chunks that a box (x, y, z) meets; others' folders and row groups are not read."""
    low, high = ([k // chunks.edge for k in v] for v in (offset[::-1], [o + n - 1 for o, n in zip(offset[::-1], size[::-1], strict=True)]))
    zones = [range(a // ZONE, b // ZONE + 1) for a, b in zip(low, high, strict=True)]
    rows = chunks.rows
    if np.prod([len(z) for z in zones]) <= MOST_ZONES:
        rows = rows.where(F.col("zone").isin([zone_of(z) for z in itertools.product(*zones)]))
    for c, a, b in zip(("cz", "cy", "cx"), low, high, strict=True):
        rows = rows.where(F.col(c).between(a, b))
    return Chunks(rows, chunks.meta, chunks.halo, chunks.edge)


def open_box(spark: SparkSession, root: str, image_id: str, offset: Sequence[int], size: Sequence[int], level: int = 0) -> tuple[ImageMeta, DataFrame]:
    """A box (x, y, z) of a level: its geometry and its voxels that are not 0, with coordinates from its corner."""
    chunks = open_level(spark, root, image_id, level)
    return chunks.meta.part(tuple(offset), tuple(size)), crop(voxels(part_of(chunks, offset, size)), offset, size)


def has_image(spark: SparkSession, root: str, image_id: str) -> bool:
    try:
        return not spark.read.schema(IMAGES).parquet(_row(root, image_id)).isEmpty()
    except AnalysisException:
        return False
