"""Scores of whole documents by a gated recurrent language model that is trained on the corpus.

Words are counted over all training documents, by 64-bit hashes. The model (gru.py) is trained on all of them too: in each round
every task goes once over its share with truncated backpropagation, from the same weights, and the
results are averaged by tokens in a tree. Then every document is scored from its first word to its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import count_cutoff, hashed_words, raw_bytes, saved, table

HEAD = 1 << 19
END_WORD = -1  # stands for the end of a text among the words' hashes
BUFFER = 4_000_000
SLICES = 16
ROUNDS = ((0, 1), (1, 4), (4, 16))
UNIGRAM_SHARE = 0.05


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (a hash), n over every text, the end of a text as END_WORD; tasks add up their own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, ends = [], 0, 0

        def counted(words: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times.astype(np.int64))], ["word", "n"])

        for b in batches:
            for words in hashed_words(raw_bytes(b.column(0))):
                waiting.append(words)
                held += len(words)
                if held >= BUFFER:
                    yield counted(*np.unique(np.concatenate(waiting), return_counts=True))
                    waiting, held = [], 0
            ends += b.num_rows
        if held:
            yield counted(*np.unique(np.concatenate(waiting), return_counts=True))
        if ends:
            yield counted(np.array([END_WORD]), np.array([ends]))

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Hashes and counts of the most frequent words, at most `head`, by falling count; tokens and distinct tokens in all."""

    def __init__(self, counts: DataFrame, head: int):
        total, distinct, ends = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == END_WORD, F.col("n")))).first()
        self.tokens, self.distinct, self.ends = int(total or 0), int(distinct), int(ends or 0)
        own = counts.where(F.col("word") != END_WORD)
        self.cutoff = count_cutoff(own, head)
        rows = own.where(F.col("n") >= self.cutoff).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
        self.hashes = rows.column("word").to_numpy().astype(np.int64).view(np.uint64)
        self.n = rows.column("n").to_numpy()
        self.whole = self.distinct - (self.ends > 0) <= len(self.n)
        self.cells = float(self.tokens + self.distinct + 1)

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts and smoothed unigram probabilities of the model's symbols."""
        counts, p = np.zeros(gru.SYMBOLS), np.zeros(gru.SYMBOLS)
        top = self.n[: gru.SYMBOLS - 2]
        counts[gru.END], counts[2 : 2 + len(top)] = self.ends, top
        p[gru.END], p[2 : 2 + len(top)] = (self.ends + 1) / self.cells, (top + 1) / self.cells
        counts[gru.OTHER], p[gru.OTHER] = self.tokens - counts.sum(), 1 - p.sum()
        return counts, p


class HashIndex:
    """Rank of a word by its 64-bit hash: an open-addressed table, looked up for many words at once."""

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(4, (2 * len(hashes)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.ranks = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        left, at = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.ranks[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[slots], self.ranks[slots] = hashes[left[put]], left[put]
            left, at = np.delete(left, put), (np.delete(at, put) + 1) & (size - 1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks, -1 for what is not there."""
        at = (hashes & self.mask).astype(np.int64)
        out = self.ranks[at]
        go = np.flatnonzero((self.keys[at] != hashes) & (out >= 0))
        while len(go):
            at[go] = (at[go] + 1) & int(self.mask)
            out[go] = self.ranks[at[go]]
            go = go[(self.keys[at[go]] != hashes[go]) & (out[go] >= 0)]
        # an empty slot has rank -1, and its key may by chance be the hash looked for
        return out


_indexes: dict[str, HashIndex] = {}


def _index(shared: tuple[str, np.ndarray, np.ndarray]) -> HashIndex:
    """Made once in a worker process for each vocabulary."""
    key, hashes, _ = shared
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = HashIndex(hashes)
    return _indexes[key]


def _symbols(ranks: np.ndarray) -> np.ndarray:
    out = np.full(len(ranks) + 1, gru.OTHER, np.int32)
    known = (ranks >= 0) & (ranks < gru.SYMBOLS - 2)
    out[:-1][known] = ranks[known] + 2
    out[-1] = gru.END
    return out


def train(texts: DataFrame, start: gru.Params, vocabulary) -> gru.Params:
    """One round: every task trains on its texts from `start`; the mean of the results, weighted by tokens."""
    sc = texts.sparkSession.sparkContext
    given, like = sc.broadcast(gru.flat(start)), {k: v.shape for k, v in start.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(vocabulary.value)
        trainer = gru.Trainer(gru.shaped(given.value, {k: np.zeros(s) for k, s in like.items()}))
        docs, n = [], 0
        for b in batches:
            for words in hashed_words(raw_bytes(b.column(0))):
                docs.append(_symbols(index.of(words)))
                n += len(docs[-1])
                if n >= BUFFER:
                    trainer.train(docs)
                    docs, n = [], 0
        if docs:
            trainer.train(docs)
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens]), pa.array([(gru.flat(trainer.p).astype(np.float64) * trainer.tokens).tobytes()])], ["tokens", "weights"])

    parts = texts.mapInArrow(run, "tokens long, weights binary").rdd.map(lambda r: (r.tokens, np.frombuffer(r.weights)))
    tokens, total = parts.treeAggregate((0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return gru.shaped(total / tokens, start) if tokens else start


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, words array<long>, times array<long>"


def score(docs: DataFrame, vocabulary, params: gru.Params, ends: int, cells: float, unigram: np.ndarray) -> DataFrame:
    """SCORED rows of doc_id, held_out and text. Words outside the head are left to be looked up: `words` and `times`."""
    sc = docs.sparkSession.sparkContext
    given, like = sc.broadcast((gru.flat(params), unigram)), {k: v.shape for k, v in params.items()}
    rest = unigram[gru.OTHER] * cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts = _index(vocabulary.value), vocabulary.value[2]
        logs = np.append(np.log10(counts + 1.0), 0.0)
        weights, unigram = given.value
        p = gru.shaped(weights, {k: np.zeros(s) for k, s in like.items()})
        docs, rows, n = [], [], 0

        def done() -> pa.RecordBatch:
            model = gru.scores(p, docs, unigram, UNIGRAM_SHARE)
            columns = list(zip(*[(*r[:5], r[5] + m, *r[6:]) for r, m in zip(rows, model.tolist(), strict=True)], strict=True))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in SCORED.split(", ")])

        for b in batches:
            for doc, held, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), hashed_words(raw_bytes(b.column(2))), strict=True):
                ranks = index.of(words)
                seq = _symbols(ranks)
                gains = logs[ranks]
                base = float(gains.sum()) + np.log10(ends + 1.0) - len(seq) * np.log10(cells)
                other = seq[:-1] == gru.OTHER
                extra = float(gains[other].sum()) - int(other.sum()) * np.log10(rest) if len(words) else 0.0
                tail, times = np.unique(words[ranks < 0], return_counts=True)
                rows.append((doc, held, len(seq), int((ranks >= 0).sum()) + (ends > 0), base, extra, tail.view(np.int64), times))
                docs.append(seq)
                n += len(seq)
                if n >= BUFFER:
                    yield done()
                    docs, rows, n = [], [], 0
        if docs:
            yield done()

    return docs.mapInArrow(run, SCORED)


def language_model_scores(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is one token, its end. A null doc_id is the empty key, which is learnt from. Repeated rows count
    as often as they are there. The driver holds the `head` most frequent words and the model; counts of all
    other words are joined where they occur. Words are told by 64-bit hashes. With no training document every symbol is
    as likely as the smoothing says. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id")) == 2).alias("held_out"))
    learnt = rows.where("not held_out")
    counts = saved(word_counts(learnt.select("text")), "word-counts")
    vocab = Vocabulary(counts, head)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((uuid.uuid4().hex, vocab.hashes, vocab.n))
    symbols, unigram = vocab.symbols()
    params = gru.initial(symbols)
    top = sc.broadcast((uuid.uuid4().hex, vocab.hashes[: gru.SYMBOLS - 2], vocab.n[: gru.SYMBOLS - 2]))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))
    for first, last in ROUNDS:
        params = train(learnt.where(part.between(first, last - 1)).select("text"), params, top)
    scored = score(rows.select("doc_id", "held_out", "text"), shared, params, vocab.ends, vocab.cells, unigram)
    if vocab.whole:
        out = scored
    else:
        kept = saved(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
        tail = kept.select("_row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("_row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
        less = counts.where(F.col("n") < vocab.cutoff)
        found = tail.join(less, "word").groupBy("_row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("_gain"))
        gain = F.coalesce("_gain", F.lit(0.0))
        out = kept.join(found, "_row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("_known", F.lit(0)), "base": F.col("base") + gain, "model": F.col("model") + gain})
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))


def op5_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
