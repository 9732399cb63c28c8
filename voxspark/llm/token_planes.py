"""Token ids in a binary file: fixed-size blocks, transposed into byte planes of shuffled bits, each plane compressed.

File: magic, then chunks. A chunk has up to BLOCK ids; its 17 or fewer bit planes (bit k of every id, packed
eight to a byte) are compressed one by one, planes that are all zero above the highest set bit being left out. The chunk
index comes last: for each chunk its offset, first id, number of ids and the sizes of its
planes; a footer holds the index's offset, the number of chunks and the magic again.
"""

from __future__ import annotations

import functools
import io
import json
import re
import struct
import uuid
import zlib
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, fresh, saved, strings, table

MAGIC = b"BPLANES1"
BLOCK = 1 << 16
END_ID = 2
#: Words of ASCII and composed Latin letters, each lowered to one letter, the same in every version of Unicode.
PLAIN = re.compile("[\x00-\x7f\u00c0-\u012f\u0131-\u0148\u014a-\u017e]*").fullmatch


def planes(ids: np.ndarray) -> list[bytes]:
    """Bit plane k: bit k of every id, from the lowest plane up."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    out = []
    for low in range(0, top, 8):
        byte = (ids >> np.uint32(low)).astype(np.uint8)
        out += [np.packbits(byte & np.uint8(1 << k)).tobytes() for k in range(min(8, top - low))]
    return out


def joined(parts: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, p in enumerate(parts):
        ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return ids


class PlaneWriter:
    def __init__(self, out, block: int = BLOCK, level: int = 3):
        self.out, self.block, self.zstd = out, block, zstandard.ZstdCompressor(level=level)
        self.waiting, self.n, self.at, self.ids, self.index = [], 0, len(MAGIC), 0, []
        out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= self.block:
            flat = np.concatenate(self.waiting)
            for i in range(0, self.n - self.block + 1, self.block):
                self._chunk(flat[i : i + self.block])
            self.n %= self.block
            self.waiting = [flat[len(flat) - self.n :].copy()] if self.n else []

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) for p in planes(ids)]
        for p in packed:
            self.out.write(p)
        self.index.append((self.at, self.ids, len(ids), [len(p) for p in packed]))
        self.at += sum(map(len, packed))
        self.ids += len(ids)

    def close(self) -> None:
        if self.n:
            self._chunk(np.concatenate(self.waiting))
        for at, first, n, sizes in self.index:
            self.out.write(struct.pack(f"<QQIB{len(sizes)}I", at, first, n, len(sizes), *sizes))
        self.out.write(struct.pack("<QI", self.at, len(self.index)) + MAGIC)


class PlaneReader:
    """Reads ids from any position: only the chunks that hold them are decompressed."""

    def __init__(self, file):
        self.file, size = file, file.seek(0, io.SEEK_END)
        file.seek(size - 20)
        at, n = struct.unpack("<QI", (tail := file.read(20))[:12])
        if tail[12:] != MAGIC:
            raise ValueError("not a plane file")
        file.seek(at)
        raw, p, self.chunks = file.read(size - 20 - at), 0, []
        for _ in range(n):
            offset, first, ids, k = struct.unpack_from("<QQIB", raw, p)
            sizes = struct.unpack_from(f"<{k}I", raw, p + 21)
            self.chunks.append((offset, first, ids, sizes))
            p += 21 + 4 * k
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def chunk(self, i: int) -> np.ndarray:
        if self.kept[0] != i:
            offset, _, n, sizes = self.chunks[i]
            self.file.seek(offset)
            d = zstandard.ZstdDecompressor()
            self.kept = i, joined([d.decompress(self.file.read(s)) for s in sizes], n)
        return self.kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        firsts = [c[1] for c in self.chunks]
        i, out = int(np.searchsorted(firsts, start, "right")) - 1, []
        while n > 0:
            got = self.chunk(i)[start - self.chunks[i][1] :][:n]
            out.append(got)
            start, n, i = start + len(got), n - len(got), i + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _splits_at_space(spec: dict) -> bool:
    """Whether no id of such a tokenizer can depend on text beyond the white space beside its word."""
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    added = [t["content"] for t in spec.get("added_tokens") or []]
    return (
        # so that lower-casing a text's ASCII letters finds every one, also in a normalised text
        all(c and c.isascii() and not set(c.lower()) & set("k;` \t\n\r\v\f\x1c\x1d\x1e\x1f") for c in added)
        and [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
        and normal[1]["pattern"] == {"Regex": r"\s+"}
        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and pre[0]["behavior"] == "Removed"
        and pre[0]["invert"]
        and not pre[1]["use_regex"]
        and not pre[1]["add_prefix_space"]
        and spec.get("post_processor") is None
    )


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    Where the tokenizer drops white space and looks at each word alone, a word's ids are kept and
    used again, so that only new words pass through the library: those of PLAIN letters by new letter runs,
    any other whole, since versions of Unicode differ in how they compose, lower and class characters. Any other tokenizer
    encodes each text as it is. So is a text that may hold an added token, which counts inside words and
    before normalisation. The result is the same.
    """

    most = 1 << 20

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = None if _splits_at_space(spec) else Tokenizer.from_file(path)
        if self.whole is None:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.path, self.full = path, None
            self.marks = [t["content"].lower().encode() for t in spec.get("added_tokens") or []]
            self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
            spec["normalizer"] = None
            spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
            self.library = Tokenizer.from_str(json.dumps(spec))
            self.words: dict[bytes, bytes] = {}
            self.runs: dict[str, bytes] = {}

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words; what is learnt first is kept, up to `most` words and as many letter runs."""
        texts = [w.decode() for w in words]
        odd = [i for i, t in enumerate(texts) if not PLAIN(t)]
        cut = [self.pieces.findall(t.lower()) if PLAIN(t) else [] for t in texts]
        runs = self.runs
        if new := list(set().union(*cut) - runs.keys()):
            coded = self.library.encode(" ".join(new), add_special_tokens=False)
            ends = (4 * np.searchsorted(np.array(coded.word_ids), np.arange(len(new) + 1))).tolist()
            raw = np.array(coded.ids, "<u4").tobytes()
            learnt = {p: raw[a:b] for p, a, b in zip(new, ends[:-1], ends[1:], strict=True)}
            if len(runs) < self.most:
                runs.update(learnt)
            else:
                runs = ChainMap(learnt, runs)
        out = {w: runs[c[0]] if len(c) == 1 else b"".join([runs[p] for p in c]) for w, c in zip(words, cut, strict=True)}
        if odd:
            out |= dict(zip([words[i] for i in odd], self._whole([texts[i] for i in odd]), strict=True))
        if len(self.words) < self.most:
            self.words.update(out)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole is not None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        raw = [t.encode() for t in texts]
        marked = {i for i, t in enumerate(raw) if any(map(t.lower().__contains__, self.marks))}
        words = [[] if i in marked else t.split() for i, t in enumerate(raw)]
        flat = list(chain.from_iterable(words))
        got = list(map(self.words.get, flat))
        if gaps := [i for i, g in enumerate(got) if g is None]:
            learnt = self._learn(list({flat[i] for i in gaps}))
            for i in gaps:
                got[i] = learnt[flat[i]]
        out, at = [], 0
        for i, own in enumerate(words):
            out.append(self._whole([texts[i]])[0] if i in marked else b"".join(got[at : at + len(own)]))
            at += len(own)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Normalised, cut and encoded by the library alone."""
        from tokenizers import Tokenizer

        if self.full is None:
            self.full = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that words are learnt once and not by every task."""
    return Encoder(path)


INDEX = "file string, file_rank int, row long, doc_id long, first long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Encodes each whole text, appends `end_id`, and writes the ids in ascending doc_id order, a file for each range of doc_ids.

    Returns the index: file, its rank among the files, row in the file, doc_id, first id in the file, n_tokens.
    Files are named afresh by each attempt and only those in the index count, so a lost
    executor's leavings are never read. A null text is empty and has the end id alone; null
    doc_ids come first; repeated doc_ids all stay, in an order that is fixed by their text.
    An empty table gives no file.
    """
    fs, root = file_system(folder)
    fs.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank, out, row, at = TaskContext.get().partitionId(), None, 0, 0
        fs, root = file_system(folder)
        end = struct.pack("<I", end_id)
        name, coder, kinds = f"{uuid.uuid4().hex}.planes", None, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                coder = encoder(tokenizer)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                writer = PlaneWriter(out, block)
            texts, rows = strings(b.column(1)), []
            for i in range(0, len(texts), 1024):
                for doc, coded in zip(b.column(0)[i : i + 1024].to_pylist(), coder.encode(texts[i : i + 1024]), strict=True):
                    ids = np.frombuffer(coded + end, "<u4")
                    writer.add(ids)
                    rows.append((name, rank, row, doc, at, len(ids)))
                    row, at = row + 1, at + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            writer.close()
            out.close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return saved(ordered.mapInArrow(run, INDEX), "token-index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """Per document of the index: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files.

    A file's ids before it are a running sum over files, of which there are as many as writing tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        opened: tuple[str, object] = ("", None)
        for b in batches:
            doc, start, n, file, first = (b.column(i) for i in range(5))
            crc = []
            for name, f, k in zip(file.to_pylist(), first.to_pylist(), n.to_pylist(), strict=True):
                if opened[0] != name:
                    opened = name, PlaneReader(fs.open_input_file(f"{root}/{name}"))
                crc.append(zlib.crc32(opened[1].ids(f, k).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([doc, start, n, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = index.groupBy("file", "file_rank").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = index.join(F.broadcast(starts), "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "file", "first")
    return rows.sortWithinPartitions("file", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")), folder)
