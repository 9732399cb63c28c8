"""Raw volumes with a text header, as a Spark data source that reads boxes and writes in place.

A header is a list of `key = value` lines and names a raw payload, x fastest. Reading: one partition for each slab of slices,
so an image of any size is spread; of a box (an option) only its own lines and voxels are read. Filters are not pushed down by
Spark: in 4.1 a relation keeps the reader that one query has narrowed, and gives it to all later ones on the same table. Writing: every task writes its voxels to their places in one payload of full size, which becomes the image when the job commits.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql import functions as F

from ..functions.geometry import ImageMeta
from ..operators.pointwise import binarize, rescale, value_range

# Fixed values of the file format: header keys with their defaults, and element types.
DEFAULTS = {
    "ObjectType": "Image", "NDims": "3", "BinaryData": "True", "BinaryDataByteOrderMSB": "False", "CompressedData": "False",
    "TransformMatrix": "1 0 0 0 1 0 0 0 1", "Offset": "0 0 0", "CenterOfRotation": "0 0 0", "AnatomicalOrientation": "RAI",
    "ElementSpacing": "1 1 1", "DimSize": "1 1 1", "ElementType": "MET_SHORT", "HeaderSize": "0", "ElementDataFile": "binary.raw",
}
ELEMENTS = {
    "MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4",
    "MET_ULONG": "u8", "MET_LONG": "i8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8",
}
SLAB_BYTES = 64 << 20


def parse_header(text: str) -> dict[str, str]:
    """Known keys and those of micro-CT headers over the defaults; other keys and blank lines are passed by. A value may hold `=`."""
    out = dict(DEFAULTS)
    for line in text.splitlines():
        key, sep, value = line.partition("=")
        if sep and (key.strip() in out or key.strip().startswith("ISQ_")):
            out[key.strip()] = value.strip()
    return out


def format_header(header: Mapping[str, str]) -> str:
    return "".join(f"{k} = {v}\n" for k, v in header.items())


def is_true(value: str) -> bool:
    return value.strip().lower() == "true"


def element_type(header: Mapping[str, str]) -> np.dtype:
    if header["ElementType"] not in ELEMENTS:
        raise ValueError(f"unknown element type {header['ElementType']}")
    return np.dtype((">" if is_true(header["BinaryDataByteOrderMSB"]) else "<") + ELEMENTS[header["ElementType"]])


def meta_of(header: Mapping[str, str]) -> ImageMeta:
    """The direction matrix is stored by columns."""
    numbers = lambda k: tuple(float(x) for x in header[k].split())
    direction = np.array(numbers("TransformMatrix")).reshape(3, 3).T.ravel()
    return ImageMeta(tuple(int(x) for x in header["DimSize"].split()), numbers("ElementSpacing"), numbers("Offset"), tuple(direction.tolist()))


def header_of(meta: ImageMeta, payload: str, element: str = "MET_SHORT") -> dict[str, str]:
    """With full precision of every number."""
    text = lambda v: " ".join(repr(float(x)) for x in v)
    own = {"DimSize": " ".join(map(str, meta.shape)), "ElementSpacing": text(meta.spacing), "Offset": text(meta.offset), "TransformMatrix": text(np.array(meta.direction).reshape(3, 3).T.ravel())}
    return {**DEFAULTS, **own, "ElementType": element, "ElementDataFile": payload}


def header_size(header: Mapping[str, str], payload_size: int) -> int:
    """-1 stands for whatever comes before the voxels."""
    size = int(header["HeaderSize"])
    return size if size >= 0 else payload_size - int(np.prod(meta_of(header).shape)) * element_type(header).itemsize


def checked(path: str, header: Mapping[str, str]) -> None:
    if not path.lower().endswith(".mhd"):
        raise TypeError(f"{path} is no mhd file")
    if is_true(header["CompressedData"]):
        raise ValueError("compressed payloads cannot be read")
    if header["ElementDataFile"] == "LIST" or len(header["ElementDataFile"].split()) != 1:
        raise ValueError("one payload file is needed")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_text(path: str) -> str:
    fs, at = _store(path)
    with fs.open_input_stream(at) as f:
        return f.read().decode()


def write_text(path: str, text: str) -> None:
    fs, at = _store(path)
    fs.create_dir(posixpath.dirname(at), recursive=True)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(text.encode())


def read_header(path: str) -> dict[str, str]:
    return parse_header(read_text(path))


def payload_path(path: str, header: Mapping[str, str]) -> str:
    raw = header["ElementDataFile"]
    return raw if raw.startswith("/") or "://" in raw else posixpath.join(posixpath.dirname(path), raw)


def value_limits(element: str) -> tuple[int, int] | None:
    """Least and largest value of an element type; none for floats."""
    kind = np.dtype(ELEMENTS[element])
    return None if kind.kind == "f" else (int(np.iinfo(kind).min), int(np.iinfo(kind).max))


class Slab(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def value_type(header: Mapping[str, str]) -> str:
    """Whole numbers stay whole: bigint, or a decimal where that does not hold them; floats are doubles."""
    kind = element_type(header)
    return "double" if kind.kind == "f" else "decimal(20,0)" if kind.kind == "u" and kind.itemsize == 8 else "bigint"


class MhdReader(DataSourceReader):
    def __init__(self, path: str, slab_bytes: int, box: str = ""):
        """`box`: six numbers, first voxel (x, y, z) and size; else the whole image."""
        self.path, self.slab_bytes = path, slab_bytes
        self.header, self.raw = self.found(path)
        fs, at = _store(self.raw)
        self.skip = header_size(self.header, fs.get_file_info(at).size)
        shape = meta_of(self.header).shape
        given = list(map(int, box.split())) or [0, 0, 0, *shape]
        # by axis, the first voxel and the one after the last
        self.box = {k: (max(0, o), min(s, o + n)) for k, o, n, s in zip("xyz", given[:3], given[3:], shape, strict=True)}

    def found(self, path: str) -> tuple[dict[str, str], str]:
        """The header, and where the payload lies."""
        header = read_header(path)
        checked(path, header)
        return header, payload_path(path, header)

    def partitions(self) -> list[Slab]:
        (x0, x1), (y0, y1), (z0, z1) = (self.box[k] for k in "xyz")
        if min(x1 - x0, y1 - y0, z1 - z0) <= 0:
            return [Slab(0, 0)]
        step = max(1, self.slab_bytes // ((x1 - x0) * (y1 - y0) * element_type(self.header).itemsize))
        return [Slab(z, min(z + step, z1)) for z in range(z0, z1, step)]

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        nx, ny, _ = meta_of(self.header).shape
        (x0, x1), (y0, y1) = self.box["x"], self.box["y"]
        kind, wide, high = element_type(self.header), x1 - x0, y1 - y0
        number = {"double": np.float64, "bigint": np.int64}.get(value_type(self.header))
        fs, at = _store(self.raw)
        y, x = np.divmod(np.arange(wide * high, dtype=np.int32), max(1, wide))
        with fs.open_input_file(at) as f:
            for z in range(slab.first, slab.last):
                lines = [(y0, wide * high)] if wide == nx else [(line, wide) for line in range(y0, y1)]
                data = bytearray()
                for line, n in lines:
                    f.seek(self.skip + ((z * ny + line) * nx + x0) * kind.itemsize)
                    data += f.read(n * kind.itemsize)
                v = np.frombuffer(bytes(data), kind)
                g = pa.array(v.astype(number)) if number else pa.array(v.astype("u8")).cast(pa.decimal128(20, 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), z, np.int32)), pa.array(y + np.int32(y0)), pa.array(x + np.int32(x0)), g], ["z", "y", "x", "g"])


class MhdWriter(DataSourceArrowWriter):
    """Voxels z, y, x and v of an image of given geometry, in any order. Absent ones are 0; of repeated ones some one stays.

    Each task writes to the same places at every attempt, so a repeated task does no harm. The payload has a name of its own
    until the job commits; then it gets the image's and the header is written. An aborted job leaves nothing.
    """

    def __init__(self, path: str, meta: ImageMeta, element: str):
        self.path, self.meta, self.element = path, meta, element
        self.kind = np.dtype("<" + ELEMENTS[element])
        self.part = f"{payload_file(path)}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(self.part) or ".", exist_ok=True)
        with open(self.part, "wb") as f:
            f.truncate(meta.n_voxels * self.kind.itemsize)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        nx, ny, nz = self.meta.shape
        limits = value_limits(self.element)
        with open(self.part, "r+b") as f:
            for b in batches:
                z, y, x = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("z", "y", "x"))
                v = b.column(b.schema.get_field_index("v")).to_numpy(zero_copy_only=False)
                if len(v) and limits and not limits[0] <= v.min() <= v.max() <= limits[1]:
                    raise ValueError(f"a value is outside {self.element}")
                if ((z < 0) | (z >= nz) | (y < 0) | (y >= ny) | (x < 0) | (x >= nx)).any():
                    raise ValueError("a voxel is outside the image")
                at = (z * ny + y) * nx + x
                order = np.argsort(at, kind="stable")
                at, data = at[order], v[order].astype(self.kind)
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else ():
                    f.seek(int(at[run[0]]) * self.kind.itemsize)
                    f.write(data[run[0] : run[-1] + 1].tobytes())
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        os.replace(self.part, payload_file(self.path))
        write_text(self.path, format_header(header_of(self.meta, posixpath.basename(payload_file(self.path)), self.element)))

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


def payload_file(path: str) -> str:
    """The payload's name in a mounted file system."""
    return (path.removeprefix("file://") if path.startswith("file://") else path)[: -len(".mhd")] + ".raw"


class MhdDataSource(DataSource):
    """spark.read.format("mhd").load(path): z, y, x and g of every voxel, in the file's own values.

    image.write.format("mhd").mode("append").option("meta", meta_text(meta)).option("element", "MET_SHORT").save(path): z, y, x and v.
    """

    @classmethod
    def name(cls) -> str:
        return "mhd"

    def header(self) -> dict[str, str]:
        return read_header(self.options["path"])

    def schema(self) -> str:
        return f"z int, y int, x int, g {value_type(self.header())}"

    def reader(self, schema) -> DataSourceReader:
        return MhdReader(self.options["path"], int(self.options.get("slabBytes", SLAB_BYTES)), self.options.get("box", ""))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        path = self.options["path"]
        if not path.lower().endswith(".mhd"):
            raise TypeError(f"{path} is no mhd file")
        if "://" in path and not path.startswith("file://"):
            raise ValueError("voxels are written to their places in mounted file systems only")
        given = {k: tuple(v) for k, v in json.loads(self.options["meta"]).items()}
        return MhdWriter(path, ImageMeta(**given), self.options.get("element", "MET_SHORT"))


def meta_text(meta: ImageMeta) -> str:
    return json.dumps(asdict(meta))


def read_mhd(spark: SparkSession, path: str, slab_bytes: int = SLAB_BYTES) -> tuple[ImageMeta, DataFrame]:
    spark.dataSource.register(MhdDataSource)
    return meta_of(MhdReader(path, slab_bytes).header), spark.read.format("mhd").option("slabBytes", slab_bytes).load(path)


def read_box(spark: SparkSession, path: str, offset: Sequence[int], size: Sequence[int], slab_bytes: int = SLAB_BYTES) -> tuple[ImageMeta, DataFrame]:
    """The part of an image that begins at voxel `offset` (x, y, z), with its own geometry and coordinates from its corner; nothing else is read."""
    spark.dataSource.register(MhdDataSource)
    meta = meta_of(read_header(path))
    if any(o < 0 or n < 1 or o + n > s for o, n, s in zip(offset, size, meta.shape, strict=True)):
        raise ValueError("the box is not within the image")
    rows = spark.read.format("mhd").option("slabBytes", slab_bytes).option("box", " ".join(map(str, (*offset, *size)))).load(path)
    return meta.part(tuple(offset), tuple(size)), rows.withColumns({k: F.col(k) - o for k, o in zip("xyz", offset, strict=True)})


def inferred_bits(low: float, high: float, is_float: bool) -> int:
    """Ten for floats, else as many as the range needs; one for a constant image."""
    return 10 if is_float else max(1, int(np.log2(max(high - low, 1)) + 1 - 1e-9))


def import_image(spark: SparkSession, path: str, bits: int | None = None, grey_range: tuple[float, float] | None = None, is_mask: bool = False) -> tuple[ImageMeta, DataFrame]:
    """The image as a voxel table with grey values from 1 on; 0 is background. A mask gets 0 and 1."""
    meta, raw = read_mhd(spark, path)
    if is_mask:
        return meta, binarize(raw.withColumn("v", F.col("g"))).select("z", "y", "x", "v")
    low, high = grey_range or value_range(raw, "g").first()
    if bits is None:
        bits = inferred_bits(low, high, element_type(MhdReader(path, SLAB_BYTES).header).kind == "f")
    return meta, rescale(raw, low, high, bits, "g").select("z", "y", "x", "v")


def write_mhd(image: DataFrame, meta: ImageMeta, path: str, element: str = "MET_SHORT", slab_bytes: int = SLAB_BYTES) -> None:
    """Header and payload; absent voxels are 0, and a value outside the element type is an error.

    In a mounted file system tasks write all voxels themselves, sorted so that they write whole lines; elsewhere, where files
    cannot be written in parts, slab by slab through the driver.
    """
    if "://" in path and not path.startswith("file://"):
        return _write_slabs(image, meta, path, element, slab_bytes)
    image.sparkSession.dataSource.register(MhdDataSource)
    rows = image.select("z", "y", "x", "v").repartitionByRange("z", "y").sortWithinPartitions("z", "y", "x")
    rows.write.format("mhd").mode("append").option("meta", meta_text(meta)).option("element", element).save(path)


def _write_slabs(image: DataFrame, meta: ImageMeta, path: str, element: str, slab_bytes: int) -> None:
    """Tasks write one file for each slab of slices; the driver streams those into the one payload that the format wants.

    A slab's file has a name of its own for each attempt, and only those that the finished job reports are joined.
    """
    nx, ny, nz = meta.shape
    kind, folder = np.dtype("<" + ELEMENTS[element]), f"{path}.slabs-{uuid.uuid4().hex}"
    slab, limits = max(1, slab_bytes // (nx * ny * kind.itemsize)), value_limits(element)
    fs, at = _store(folder)
    fs.create_dir(at)

    def work(key, group):
        if limits and len(group) and not limits[0] <= group["v"].min() <= group["v"].max() <= limits[1]:
            raise ValueError(f"a value is outside {element}")
        first = int(key[0]) * slab
        data = np.zeros((min(slab, nz - first), ny, nx), kind)
        data[group["z"] - first, group["y"], group["x"]] = group["v"]
        name = f"{uuid.uuid4().hex}.raw"
        fs, at = _store(folder)
        with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
            f.write(data.tobytes())
        return group.head(1).assign(slab=int(key[0]), file=name)[["slab", "file"]]

    rows = image.select("z", "y", "x", "v", F.floor(F.col("z") / slab).alias("slab")).groupBy("slab").applyInPandas(work, "slab long, file string").collect()
    files = {r.slab: r.file for r in rows}
    raw = path[:-4] + ".raw"
    out_fs, out_at = _store(raw)
    with out_fs.open_output_stream(out_at, compression=None) as out:
        for i in range(-(-nz // slab)):
            if i not in files:
                out.write(bytes(min(slab, nz - i * slab) * ny * nx * kind.itemsize))
                continue
            with fs.open_input_stream(f"{at}/{files[i]}") as f:
                while part := f.read(8 << 20):
                    out.write(part)
    fs.delete_dir(at)
    head_fs, head_at = _store(path)
    with head_fs.open_output_stream(head_at, compression=None) as f:
        f.write(format_header(header_of(meta, posixpath.basename(raw), element)).encode())
