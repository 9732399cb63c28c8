"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has a bit for each majority among the hashes of a text's four-word shingles. Two fingerprints link where
few bits differ. Distinct fingerprints form a binary trie by their bits; the join walks down pairs of nodes of one
depth together, adds up the bits in which their paths differ, and drops a pair as soon as it exceeds what is allowed there.

To spread the tries and to prune early, the 64 bits are read in rotations: cut into one block more than the bits allowed
to differ, going round from some block on no more than l - 1 bits differ within the first l blocks (the sums along a ring
cannot all run ahead of their mean). So each rotation starts with a block in which nothing may differ, which deals
fingerprints out by that block, and allows one bit more with every further block. Of the links only those are sent
on that join what a task has not joined yet, and all that lies near a group's most frequent fingerprint is joined with it
first, so a large group of near copies gives about as many links as it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw_bytes, saved, table, tidy
from .components import connected_components

WORDS = 4
SEED = 42
MOST_BITS = 4
TILE = 1 << 19  #: fingerprints that one task joins with as many others; larger groups are cut into tiles, and pairs of tiles joined
PIECE = 1 << 16
PAIRS = 1 << 19
LEAF = 12

_hash = partial(xxhash.xxh64_digest, seed=SEED)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """As a signed 64-bit number; a text without words has 0."""
    words = text.lower().split()
    if not words:
        return 0
    flat, width = b" ".join(words), min(WORDS, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last, n = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        h = np.frombuffer(b"".join([_hash(flat[a:b]) for a, b in zip(first[i : i + PIECE], last[i : i + PIECE], strict=True)]), np.uint8).reshape(-1, 8)
        if len(h) < 256:
            counts += np.unpackbits(h, axis=1).sum(0, dtype=np.int64)
        else:
            cells = np.bincount((h + 256 * np.arange(8)).ravel(), minlength=2048).reshape(8, 256)
            counts += (cells @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f of every whole text, written. Null and empty texts have 0."""
    key = next(f for f in docs.schema.fields if f.name == "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(fingerprint, raw_bytes(b.column(1)))), pa.int64())], ["doc_id", "f"])

    return saved(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key.dataType.simpleString()}, f long"), "fingerprints")


# --- the join within a task -----------------------------------------------------------------------


def block_sizes(most: int) -> list[int]:
    """Bits of each of most + 1 blocks, as equal as can be."""
    n = most + 1
    return [64 // n + (i < 64 % n) for i in range(n)]


def allowances(most: int, rotation: int) -> np.ndarray:
    """Bits that may differ after each bit of the path, in the rotation that starts with that block."""
    sizes = block_sizes(most)
    return np.repeat(np.arange(most + 1), sizes[rotation:] + sizes[:rotation])


class Links:
    """Sets of positions, and the links that joined two of them."""

    def __init__(self, n: int):
        self.label, self.found = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray, tell: bool = True) -> None:
        low, high = np.minimum(self.label[a], self.label[b]), np.maximum(self.label[a], self.label[b])
        new = np.flatnonzero(low != high)
        if not len(new):
            return
        new = new[np.unique(low[new] * len(self.label) + high[new], return_index=True)[1]]
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        for i, x, y in zip(new.tolist(), low[new].tolist(), high[new].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                above[max(x, y)] = min(x, y)
                if tell:
                    self.found.append((int(a[i]), int(b[i])))
        to = np.arange(len(self.label))
        for x in above:
            to[x] = root(x)
        self.label = to[self.label]


def trie_join(keys: np.ndarray, allowed: np.ndarray, links: Links, sides: np.ndarray | None = None) -> None:
    """Adds links between all keys (sorted, distinct, unsigned) within the allowance along their paths, and maybe others that differ in no more bits in all.

    Nodes are ranges of the sorted keys. Pairs of ranges that are joined already, or of one side where there are sides, are
    dropped; pairs of few keys are compared directly. At most about PAIRS pairs are held at once.
    """
    most, n = int(allowed.max()), len(keys)

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(keys[i] ^ keys[j]) <= most
        if sides is not None:
            near &= sides[i] != sides[j]
        links.add(i[near], j[near])

    at = np.arange(n - 1)
    compare(at, at + 1)
    first = np.int64(np.argmax(allowed > 0))  # before, no bits may differ: whole blocks go together
    cut = np.flatnonzero(np.append(True, (keys[1:] >> np.uint64(64 - first)) != (keys[:-1] >> np.uint64(64 - first))))
    low, high = cut, np.append(cut[1:], n)
    stack = [(int(first), low, high, low, high, np.zeros(len(low), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, e = stack.pop()
        own = alo == blo
        keep = ~own | (ahi - alo > 1)
        for marks in [links.label] if sides is None else [links.label, sides]:
            turns = np.concatenate([[0], np.cumsum(marks[1:] != marks[:-1])])
            keep &= ~((turns[ahi - 1] == turns[alo]) & (turns[bhi - 1] == turns[blo]) & (marks[alo] == marks[blo]))
        alo, ahi, blo, bhi, e, own = (x[keep] for x in (alo, ahi, blo, bhi, e, own))
        few = (ahi - alo) * (bhi - blo) <= LEAF if depth < 64 else np.ones(len(alo), bool)
        if few.any():
            a, b, size = alo[few], blo[few], (bhi - blo)[few]
            times = (ahi - alo)[few] * size
            row = np.repeat(np.arange(len(a)), times)
            k = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            i, j = a[row] + k // size[row], b[row] + k % size[row]
            compare(i[i < j], j[i < j])
            alo, ahi, blo, bhi, e, own = (x[~few] for x in (alo, ahi, blo, bhi, e, own))
        if not len(alo):
            continue
        if len(alo) > PAIRS:
            half = len(alo) // 2
            stack += [(depth, *(x[part] for x in (alo, ahi, blo, bhi, e))) for part in (slice(half, None), slice(half))]
            continue
        zeros = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1) == 0)])
        amid, bmid = alo + zeros[ahi] - zeros[alo], blo + zeros[bhi] - zeros[blo]
        other = ~own
        nodes = [
            (alo, amid, blo, bmid, e), (amid, ahi, bmid, bhi, e), (alo, amid, bmid, bhi, e + 1),
            (amid[other], ahi[other], blo[other], bmid[other], e[other] + 1),
        ]
        new = [np.concatenate([x[i] for x in nodes]) for i in range(5)]
        good = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= allowed[depth])
        stack.append((depth + 1, *(x[good] for x in new)))


# --- the join in Spark ----------------------------------------------------------------------------

DEALT = "r int, block long, i int, j int, side int, f long, near boolean"


def _rotated(f: np.ndarray, shift: int) -> np.ndarray:
    return f if not shift else (f << np.uint64(shift)) | (f >> np.uint64(64 - shift))


def _join_groups(most: int):
    offsets = np.concatenate([[0], np.cumsum(block_sizes(most))[:-1]]).tolist()

    def joined(r: int, tiled: bool, f: np.ndarray, near: np.ndarray, side: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        keys = _rotated(f, offsets[r])
        order = np.argsort(keys)
        keys, f, near, side, block = keys[order], f[order], near[order], side[order], block[order]
        links = Links(len(keys))
        close = np.flatnonzero(near)  # all within reach of their group's most frequent fingerprint
        _, first, which = np.unique(block[close], return_index=True, return_inverse=True)
        links.add(close[first[which]], close, tell=False)
        trie_join(keys, allowances(most, r), links, side if tiled else None)
        a, b = (np.array(x, np.int64) for x in (zip(*links.found) if links.found else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(f[a].view(np.int64)), pa.array(f[b].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one group come together; whole groups of one rotation are joined at once, as many as make a tile."""
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size > 1:
                f, near, side, block = (np.concatenate(x) for x in zip(*held, strict=True))
                yield joined(last[0], last[2] != last[3], f.view(np.uint64), near, side, block)
            held, size = [], 0

        for b in batches:
            r, block, i, j, side, f = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            near = b.column(6).to_numpy(zero_copy_only=False).astype(bool)
            cut = np.flatnonzero((r[1:] != r[:-1]) | (block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip(np.append(0, cut).tolist(), np.append(cut, len(f)).tolist(), strict=True):
                if lo == hi:
                    continue
                group = (int(r[lo]), int(block[lo]), int(i[lo]), int(j[lo]))
                if last is not None and group != last and (group[0] != last[0] or size >= TILE // 4 or (group[2:], last[2:]) != ((0, 0), (0, 0))):
                    yield from flush()
                last = group
                held.append((f[lo:hi], near[lo:hi], side[lo:hi], block[lo:hi]))
                size += hi - lo
        yield from flush()

    return run


def near_links(classes: DataFrame, most: int = MOST_BITS, tile: int = TILE) -> DataFrame:
    """Links a, b between distinct fingerprints, from `classes` (f distinct, n how often): their components are those of all pairs that differ in `most` bits or fewer.

    Each fingerprint goes once to its group in every rotation; groups are dealt out by their first block, of which there are
    fewer than (most + 1) * 2^(64 / (most + 1) + 1), so sizes and hubs of groups are a small table at any size of the input.
    A group of more than `tile` is cut into tiles, whose pairs are joined by a task each; within reach of the hub
    fingerprints are joined with that at once. A task holds a tile or two.
    """
    sizes = block_sizes(most)
    each, at = [], 0
    for r, size in enumerate(sizes):
        turned = F.col("f") if not at else F.shiftleft("f", at).bitwiseOR(F.shiftrightunsigned("f", 64 - at))
        each.append(F.struct(F.lit(r).alias("r"), F.shiftrightunsigned(turned, 64 - size).alias("block")))
        at += size
    rows = classes.select("f", "n", F.explode(F.array(*each)).alias("g")).select("f", "n", "g.r", "g.block")
    groups = rows.groupBy("r", "block").agg(F.count(F.lit(1)).alias("rows"), F.max_by("f", F.struct("n", "f")).alias("hub")).where("rows > 1")
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("hub"))) <= most
    rows = rows.join(F.broadcast(groups), ["r", "block"]).withColumn("near", near)
    tiles = F.ceil(F.col("rows") / tile).cast("int")
    own = F.pmod(F.xxhash64("f"), F.col("tiles")).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # tile (0, 0) is a whole group; a group in tiles has tiles (1, 1), (1, 2) and so on
    cell = lambda x: F.when(F.col("tiles") == 1, 0).otherwise(x + 1)
    side = (F.col("own") > F.col("k")).cast("int")
    dealt = rows.select("r", "block", cell(F.least("own", "k")).alias("i"), cell(F.greatest("own", "k")).alias("j"), side.alias("side"), "f", "near")
    hubs = rows.where("near and f <> hub and k = 0").select(F.col("hub").alias("a"), F.col("f").alias("b"))
    dealt = dealt.repartition("r", "block", "i", "j").sortWithinPartitions("r", "i", "j", "block")
    return hubs.union(dealt.mapInArrow(_join_groups(most), "a long, b long"))


@tidy
def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row.

    Texts whose fingerprints differ in `most` bits or fewer are linked; component_id is the smallest doc_id that links reach.
    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay. A null doc_id links
    others but is no component_id unless there is no other. Columns beside doc_id and text are left out. An empty table gives no row.
    """
    rows = fingerprints(docs)
    classes = saved(rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "classes")
    links = saved(near_links(classes.select("f", "n"), most).distinct(), "near-links")
    known = classes.join(connected_components(links).withColumnsRenamed({"node": "f", "comp": "c"}), "f", "left").withColumn("c", F.coalesce("c", "f"))
    known = saved(known.select("f", "c", "least"), "component-of")
    least = saved(known.groupBy("c").agg(F.min("least").alias("component_id")), "components")
    named = saved(known.select("f", "c").join(least, "c").select("f", "component_id"), "named")
    return rows.join(named, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
