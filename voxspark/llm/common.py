"""What the text operators share: the shared folder, written tables, words and shingles.

Words are runs of code points outside ``\\x20\\x09-\\x0D``; a null text has none.
Every operator that adds columns replaces an input column of the same name.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BATCH_ROWS = 1000
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests on one machine, a folder is made and set;
    on a cluster that is an error, since a local folder would not be shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, batch: int = BATCH_ROWS) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: cuts the lineage.

    Meanwhile Arrow batches hold at most `batch` rows, since a row may be a long text; the session's
    setting is then put back.
    """
    path, conf, key = fresh(df.sparkSession, label), df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(batch))
    try:
        df.write.parquet(path)
        _written.append(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if p in _written:
            _written.remove(p)


def tidy(operator):
    """The operator, which on its way deletes the tables that it has written and that its result does not read."""

    @functools.wraps(operator)
    def run(*given, **named) -> DataFrame:
        before = set(_written)
        result = operator(*given, **named)
        read = "\n".join(result.inputFiles())
        discard(result.sparkSession, [p for p in _written if p not in before and p.rpartition("/")[2] not in read])
        return result

    return run


def count_cutoff(counts: DataFrame, most: int) -> int:
    """A least value of column n from which on there are at most `most` rows.

    Counts are added up by their first seven bits, so what the driver gets is a few thousand rows at most.
    """
    level = F.expr("if(n < 128, n, shiftleft(shiftright(n, cast(floor(log2(n)) as int) - 6), cast(floor(log2(n)) as int) - 6))")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    cutoff = levels[0].level + (1 << max(0, levels[0].level.bit_length() - 7)) if levels else 1
    for r in levels:
        most -= r.rows
        if most < 0:
            break
        cutoff = r.level
    return cutoff


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Iterable[str], name: str) -> str:
    """A name like `name` that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, schema_fields) -> tuple[list[str], "object"]:
    """Input columns that stay beside the new fields, and the schema of both."""
    from pyspark.sql.types import StructType

    new = {f.name.lower() for f in schema_fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    return [f.name for f in kept], StructType([*kept, *schema_fields])


def raw_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, empty for null."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [s or "" for s in column.to_pylist()]


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_R32, _R29 = np.uint64(32), np.uint64(29)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _R32)
    h *= _M2
    h ^= h >> _R29
    h *= _M1
    return h ^ (h >> _R32)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each five-word window, in order; of the whole sequence where it is shorter."""
    n = len(words)
    if not n:
        return words
    width = min(SHINGLE, n)
    m = n - width + 1
    h = np.full(m, width, np.uint64)
    for k in range(width):
        h ^= h >> _R29
        h *= _M1
        h += words[k : k + m]
    return mixed(h)


_PIECE, _GROUP = 1 << 18, 1 << 21
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _piece_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the bytes, and where it begins: sums of letter values times powers, from running sums."""
    codes = np.frombuffer(buffer, np.uint8)
    up, down = _power_tables(max(_PIECE, len(codes)))
    white = _IS_WHITE[codes]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    if not white[-1]:
        edge = np.concatenate([edge, [len(codes)]])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_LETTERS[codes] * up[: len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _cuts(text: bytes) -> list[bytes]:
    """Pieces of a long text, cut behind white space."""
    out, at = [], 0
    while at < len(text):
        size = _PIECE
        while True:
            part = text[at : at + size]
            if at + size >= len(text):
                break
            cut = max(map(part.rfind, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
            if cut >= 0:
                part = part[: cut + 1]
                break
            size *= 2
        out.append(part)
        at += len(part)
    return out


def word_hash_lists(texts: list[bytes], lower: bool = True) -> list[np.ndarray]:
    """Hashes of the words of each text, A-Z lowered if asked for, many short texts at a time."""
    fold = bytes.lower if lower else bytes
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        if len(texts[i]) > _PIECE:
            out.append(np.concatenate([_piece_hashes(p)[0] for p in _cuts(fold(texts[i]))]))
            i += 1
            continue
        group, size = [], 0
        while i < len(texts) and size + len(texts[i]) < _PIECE:
            group.append(texts[i])
            size += len(texts[i]) + 1
            i += 1
        if not group:
            group, i = [texts[i]], i + 1
        hashes, starts = _piece_hashes(fold(b" ".join(group)) + b" ")
        ends = np.cumsum([len(t) + 1 for t in group])
        at = np.searchsorted(starts, ends)
        out += [hashes[a:b] for a, b in zip(np.concatenate([[0], at[:-1]]), at, strict=True)]
    return out


def hashed_words(texts: Iterable[bytes], lower: bool = True) -> Iterator[np.ndarray]:
    """Hashes of the words of each whole text, a few MB of texts at a time."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= _GROUP:
            yield from word_hash_lists(group, lower)
            group, size = [], 0
    yield from word_hash_lists(group, lower)


def shingle_sets_of(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each whole text, a few MB of texts at a time."""

    def done(group: list[bytes]) -> Iterator[np.ndarray]:
        words = word_hash_lists(group)
        flat = np.concatenate(words)
        whole, at = shingle_hashes(flat) if len(flat) >= SHINGLE else flat[:0], 0
        for w in words:
            n = len(w)
            yield np.unique(whole[at : at + n - SHINGLE + 1] if n >= SHINGLE else shingle_hashes(w))
            at += n

    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= _GROUP:
            yield from done(group)
            group, size = [], 0
    if group:
        yield from done(group)


def native_words(text):
    """The words as an array column, from SQL functions alone."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def local_path(uri: str) -> str | None:
    return uri[len("file://") :] if uri.startswith("file://") else (uri if uri.startswith("/") else None)


def file_system(uri: str):
    """(file system, path) of a folder for Python workers: mounted, or any store that pyarrow opens."""
    from pyarrow import fs

    path = local_path(uri)
    if path is not None:
        return fs.LocalFileSystem(), os.path.normpath(path)
    return fs.FileSystem.from_uri(uri)
