"""Micro-CT headers of 128 little-endian 32-bit words, turned into headers that read the same payload."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSourceReader

from ..functions.geometry import ImageMeta
from .mhd import DEFAULTS, SLAB_BYTES, MhdDataSource, MhdReader, _store, meta_of

# Fixed values of the file format: word numbers, and the names of further words in a header.
DIMENSIONS, EXTENTS, FIRST_EXTRA, ENERGY, INTENSITY, DATA_OFFSET = 11, 14, 17, 42, 43, 127
EXTRA = ("ISQ_slice_thickness_um", "ISQ_slice_increment_um", "ISQ_slice_1_pos_um", "ISQ_min_data_value", "ISQ_max_data_value", "ISQ_mu_scaling")


def read_header(data: bytes) -> dict[str, object]:
    """Size and spacing in mm by x, y, z, the further words by name, and where the voxels begin."""
    if len(data) < 512:
        raise ValueError("the header is cut off")
    w = struct.unpack("<128i", data[:512])
    size = w[DIMENSIONS : DIMENSIONS + 3]
    if min(size) < 1:
        raise ValueError("the image has no voxels")
    out: dict[str, object] = {"size": size, "spacing": tuple(e / n / 1000 for e, n in zip(w[EXTENTS : EXTENTS + 3], size, strict=True)), "offset": (w[DATA_OFFSET] + 1) * 512}
    out |= dict(zip(EXTRA, w[FIRST_EXTRA : FIRST_EXTRA + 6], strict=True))
    return out | {"ISQ_energy_V": w[ENERGY], "ISQ_intensity_muA": w[INTENSITY]}


def to_mhd(data: bytes, payload: str) -> dict[str, str]:
    """A header that points at the original file; its payload is not copied."""
    h = read_header(data)
    own = {"DimSize": " ".join(map(str, h["size"])), "ElementSpacing": " ".join(map(repr, h["spacing"])), "HeaderSize": "-1", "ElementDataFile": payload}
    return {**DEFAULTS, **own, **{k: str(v) for k, v in h.items() if k.startswith("ISQ_")}}


class IsqReader(MhdReader):
    """The payload lies behind the header in one file."""

    def found(self, path: str) -> tuple[dict[str, str], str]:
        fs, at = _store(path)
        with fs.open_input_stream(at) as f:
            return to_mhd(f.read(512), path), path


class IsqDataSource(MhdDataSource):
    """spark.read.format("isq").load(path): z, y, x and g of every voxel, a partition for each slab."""

    @classmethod
    def name(cls) -> str:
        return "isq"

    def header(self) -> dict[str, str]:
        return IsqReader(self.options["path"], SLAB_BYTES).header

    def reader(self, schema) -> DataSourceReader:
        return IsqReader(self.options["path"], int(self.options.get("slabBytes", SLAB_BYTES)), self.options.get("box", ""))


def read_isq(spark: SparkSession, path: str, slab_bytes: int = SLAB_BYTES) -> tuple[ImageMeta, DataFrame]:
    spark.dataSource.register(IsqDataSource)
    return meta_of(IsqReader(path, slab_bytes).header), spark.read.format("isq").option("slabBytes", slab_bytes).load(path)
