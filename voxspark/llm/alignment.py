"""Alignment of two tokenizers' tokens on the bytes of a text, and the ids that they agree on.

Tokenizer A cuts a space and the text, tokenizer B puts the space before the text itself. Character offsets of A's library and
byte spans of B's are coarse cuts: where a token is but a part of a character, as tokens of byte-level and byte-fallback
vocabularies may be, its end is refined by its decoded bytes. Ends that both have cut a text into groups, and the tokens
that end there are linked.

A word with the space or line break before it is cut alike in every text (where B's vocabulary has no piece that goes
over such a place, which is looked up), so it is aligned once and its alignment kept in the worker; texts
with other white space are aligned whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, tidy

SPACE = "▁"
KEPT = 1 << 20  #: words whose alignments a worker keeps
TEXTS = 256
BROADCAST_PAIRS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 as it is, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def refined(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens from their spans' ends; where spans do not have the tokens' sizes, those are added up from the last end that fits."""
    starts = np.concatenate([[0], coarse[:-1]])
    off = np.flatnonzero(coarse - starts != sizes)
    if not len(off):
        return coarse
    out = coarse.copy()
    for run in np.split(off, np.flatnonzero(np.diff(off) > 1) + 1):
        out[run] = starts[run[0]] + np.cumsum(sizes[run])
    return out


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings are plain text
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(letters.get, token)) if all(map(letters.__contains__, token)) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p or " " in p for p in pieces)
        self.names = {end: [f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b)))] for end in ",|;"}
        self.known: dict[str, int] = {}
        self.numbers = np.zeros((0, 3), np.int64)
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.texts: list[bytes] = []

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and ends (bytes of a space and the text) of A's and of B's tokens; None where the bytes of either differ."""
        whole = f" {text}"
        raw = whole.encode()
        coded, spans = self.a.encode(whole, add_special_tokens=False), self.b.encode(text, return_type="proto").pieces
        a, b = coded.ids, [p.id for p in spans]
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        a, b, coarse = np.array(a, np.int64), np.array(b, np.int64), np.array([e for _, e in coded.offsets], np.int64)
        if len(raw) != len(whole):  # characters to bytes
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            coarse = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)])[coarse]
        return a, refined(coarse, self.sizes_a[a]), b, refined(np.array([p.end + 1 for p in spans], np.int64), self.sizes_b[b])

    def aligned(self, text: str, ends: np.ndarray) -> tuple[np.ndarray, list[bytes], list[np.ndarray]] | None:
        """Of a space and the text, by parts with those ends: numbers of tokens and groups, the groups as text, and the linked ids.

        None where the bytes differ, or where a part does not end with a token of both.
        """
        if (got := self.tokens(text)) is None:
            return None
        a, ends_a, b, ends_b = got
        common, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        cut = np.searchsorted(common, ends)
        if cut[-1] >= len(common) or (common[cut] != ends).any():
            return None
        name, is_last_a, is_last_b = self.names, np.zeros(len(a), bool), np.zeros(len(b), bool)
        is_last_a[last_a] = is_last_b[last_b] = True
        parts = [name["|" if x else ","][i] for i, x in zip(a.tolist(), is_last_a.tolist(), strict=True)]
        parts += [name[";" if x else ","][i] for i, x in zip(b.tolist(), is_last_b.tolist(), strict=True)]
        order = np.argsort(np.concatenate([2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1]), kind="stable")
        parts = [parts[i] for i in order.tolist()]
        at = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[np.cumsum(np.diff(np.append(-1, last_a)) + np.diff(np.append(-1, last_b)))[cut] - 1]
        flat, begin = "".join(parts).encode(), np.append(0, at[:-1])
        n = np.diff(np.stack([np.searchsorted(ends_a, ends, "right"), np.searchsorted(ends_b, ends, "right"), cut + 1], -1), axis=0, prepend=0)
        pairs = a[last_a] << 32 | b[last_b]
        return n, [flat[i : j - 1] for i, j in zip(begin.tolist(), at.tolist(), strict=True)], np.split(pairs, cut[:-1] + 1)

    def _learn(self, words: list[str]) -> None:
        """New words, all in one made-up text, which begins with a word of its own: each follows a space, or begins with a line break."""
        units = [" a", *[w if w[:1] == "\n" else f" {w}" for w in words]]
        ends = np.cumsum([len(u.encode()) for u in units])
        found = self.aligned("".join(units)[1:], ends)
        if found is None:  # some word is not given back; its texts are aligned whole
            each = [self.aligned("a" + u, np.array([2, 2 + len(u.encode())])) for u in units[1:]]
            found = [(0, 0, 0), *[x[0][1] if x else (-1, 0, 0) for x in each]], [b"", *[x[1][1] if x else b"" for x in each]], [np.zeros(0, np.int64), *[x[2][1] if x else np.zeros(0, np.int64) for x in each]]
        at = len(self.texts)
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.numbers = np.concatenate([self.numbers, np.array(found[0][1:], np.int64)])
        self.texts += found[1][1:]
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(list(map(len, found[2][1:])))])
        self.pairs = np.concatenate([self.pairs, *found[2][1:]])

    def _forget(self, words: list[str], most: int) -> None:
        for w in words:
            self.known.pop(w, None)
        self.numbers, self.starts, self.texts = self.numbers[:most], self.starts[: most + 1], self.texts[:most]
        self.pairs = self.pairs[: self.starts[-1]]

    def rows(self, texts: list[str]) -> list[tuple]:
        """n_a, n_b, n_groups, groups_sha256, distinct linked ids and how often each is linked, of each text."""
        plain = [bool(self.cuts and t and SPACE not in t and " ".join(t.split()) == t.replace("\n", " ")) for t in texts]
        words = [t.replace("\n", " \n").split(" ") if p else [] for t, p in zip(texts, plain, strict=True)]
        had, new = len(self.texts), list(set(chain.from_iterable(words)) - self.known.keys())
        if new:
            self._learn(new)
        out: list[tuple | None] = []
        for own in words:
            at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            n = self.numbers[at]
            if not len(own) or (n[:, 0] < 0).any():
                out.append(None)
                continue
            which, times = np.unique(at, return_counts=True)
            size = self.starts[which + 1] - self.starts[which]
            cell = np.repeat(self.starts[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out.append((*n.sum(0).tolist(), self._digest(b";".join([self.texts[i] for i in at.tolist()])), *self._summed(self.pairs[cell], np.repeat(times, size))))
        if len(self.texts) > KEPT:
            self._forget(new[max(0, KEPT - had) :], max(KEPT, had))
        for i, t in enumerate(texts):
            if out[i] is None and t and (found := self.aligned(t, np.array([len(t.encode()) + 1]))):
                pairs = found[2][0]
                out[i] = (*found[0][0].tolist(), self._digest(found[1][0]), *self._summed(pairs, np.ones(len(pairs), np.int64)))
        return [x or (0, 0, 0, "", [], []) for x in out]

    @staticmethod
    def _digest(text: bytes) -> str:
        return hashlib.sha256(text).hexdigest()

    @staticmethod
    def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[list[int], list[int]]:
        ids, which = np.unique(pairs, return_inverse=True)
        return ids.tolist(), np.bincount(which, times, len(ids)).astype(np.int64).tolist()


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(path_a, path_b)


ALIGNED = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`_row` (a number of its own for every row), doc_id, and of every whole text: n_a, n_b, n_groups, groups_sha256, pairs (distinct linked ids, a << 32 | b) and times; written.

    Texts null, empty, or whose bytes either tokenizer does not give back have no tokens.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["_row", "doc_id", *[c.split()[0] for c in ALIGNED.split(", ")]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                rows = aligner(path_a, path_b).rows([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds, strict=True)]], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    return saved(numbered.mapInArrow(run, f"_row long, doc_id {key}, {ALIGNED}"), "aligned")


def linked_pairs(rows: DataFrame) -> DataFrame:
    """pair, count (links of all texts) and best (whether no other pair of its B id has more), written; from rows of aligned().

    Counts are added up in every task first. The highest count by B id has at most as many rows as B's vocabulary, and is broadcast.
    """
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = saved(each.groupBy("pair").agg(F.sum("times").alias("count")), "pair-counts").withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return saved(counts.join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")


@tidy
def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    n_best: links whose pair is the most frequent of its B id (ties count); count_sum: the links' pairs' counts, added up. Rows
    without tokens have zeros and an empty hash. Repeated rows stay and count each. Other columns are left out. An empty table gives no row.
    The table of pairs is broadcast where it is counted and small; beyond, links are shuffled by pair, where Spark splits those of frequent ones.
    """
    rows = aligned(docs, path_a, path_b)
    pairs = linked_pairs(rows)
    known = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("_row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    own = each.join(known, "pair").groupBy("_row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.drop("pairs", "times").join(own, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", *numbers, "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
