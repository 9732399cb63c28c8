"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_words, mixed, raw_bytes, strings, table, with_columns

BUCKETS = 1 << 14
QUANTILE_BINS = 4096
BROADCAST_LABELS = 1 << 20
QUANTILE = 0.002
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Ratio:
    """Log-ratio of each bucket and the threshold of a kept document's mean."""

    weights: np.ndarray
    threshold: float


def features(h: np.ndarray) -> np.ndarray:
    """Bucket of every word and every pair of neighbours, from the words' hashes."""
    both = np.concatenate([h, h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]])
    return (mixed(both) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, raw, target: n-gram counts over every document, and over those in `trusted` (doc_id).

    One pass; each task adds up its own table of buckets, so the tables that are shuffled are bounded by
    tasks x buckets whatever the rows are. `trusted` has distinct ids, any number of them: BROADCAST_LABELS are
    broadcast at most, and the texts are shuffled once to meet more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for words, good in zip(hashed_words(raw_bytes(b.column(0)), lower=False), b.column(1).to_pylist(), strict=True):
                if len(words):
                    n = np.bincount(features(words), minlength=BUCKETS)
                    sums[0] += n
                    if good:
                        sums[1] += n
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    marked = docs.select("doc_id", "text").join(few(trusted.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left")
    parts = marked.select("text", "good").mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def few(ids: DataFrame) -> DataFrame:
    """Broadcast where they are counted and at most BROADCAST_LABELS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_LABELS else ids


def labelled(labels: DataFrame, quality: int) -> DataFrame:
    """All labelled ids of that quality, each once."""
    return labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def quantile_of(counts: DataFrame, q: float) -> float | None:
    """The exact quantile, between neighbours in proportion, of values `llr` that occur `n` times each; None without any.

    The range is cut into bins, then the bin that holds the rank, until that has one value: the driver gets QUANTILE_BINS rows a
    round at most, and nothing is sorted or gathered in a task.
    """
    low, high, total = counts.agg(F.min("llr"), F.max("llr"), F.sum("n")).first()
    if not total:
        return None
    at = (total - 1) * q
    rank, below, upto = int(at), 0, 0
    while True:
        bins = F.least(F.floor((F.col("llr") - low) / (high - low) * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1)) if high > low else F.lit(0)
        rows = counts.where(F.col("llr").between(low, high)).groupBy(bins.alias("bin")).agg(F.sum("n").alias("n"), F.min("llr").alias("low"), F.max("llr").alias("high")).collect()
        for r in sorted(rows):
            if (upto := below + r.n) > rank:
                low, high = r.low, r.high
                break
            below = upto
        if low == high:
            break
    part = at - rank
    if not part or rank + 1 < upto:
        return low
    return low + part * (counts.where(F.col("llr") > low).agg(F.min("llr")).first()[0] - low)


def fit_ratio(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> Ratio:
    """Both multinomials with one added to each bucket, and the threshold.

    The trusted target is all documents of quality 1; raw counts cover all documents. The threshold is the middle between
    the given low quantile of the trusted documents' own mean log-ratio and the 0.9 quantile of those
    labelled 0, where the latter is lower, else the former: trusted documents stay but for
    few. With no trusted document the ratio is 0 everywhere and every document passes. Documents meet their
    labels by id after they have been scored, so that no text is moved for the threshold.
    """
    good = labelled(labels, 1).persist()
    counts = np.zeros((2, BUCKETS))
    for r in bucket_counts(docs, good).toLocalIterator():
        counts[0, r.bucket], counts[1, r.bucket] = r.raw, r.target
    if not counts[1].sum():
        return Ratio(np.zeros(BUCKETS), 0.0)
    raw, target = counts + 1
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())
    known = good.withColumn("good", F.lit(True)).unionByName(labelled(labels, 0).withColumn("good", F.lit(False)))
    scored = apply_ratio(docs.select("doc_id", "text"), Ratio(weights, 0.0)).where(~F.col("base_failed")).select("doc_id", "llr")
    counts = scored.join(few(known), "doc_id").groupBy("good", "llr").agg(F.count(F.lit(1)).alias("n")).persist()
    low = quantile_of(counts.where("good"), quantile)
    high = quantile_of(counts.where("not good"), 0.9)
    counts.unpersist()
    good.unpersist()
    low = 0.0 if low is None else low
    return Ratio(weights, (low + min(low, low if high is None else high)) / 2)


def repeated_words(codes: np.ndarray) -> int:
    """Words in a three-word window that occurs twice or more."""
    n = len(codes)
    if n < 4:
        return 0
    k = int(codes.max()) + 1
    pair = codes[:-1] * k + codes[1:]
    if k > 2_000_000:  # the product of three would not fit
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * k + codes[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    if not again.any():
        return 0
    cover = np.zeros(n, bool)
    for i in range(3):
        cover[i : n - 2 + i] |= again
    return int(cover.sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = [*[T.StructField(c, T.LongType()) for c in NUMBERS], T.StructField("base_failed", T.BooleanType()), T.StructField("llr", T.DoubleType()), T.StructField("kept", T.BooleanType())]


def apply_ratio(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """Adds the counts of every whole text, base_failed, llr (mean log-ratio an n-gram) and kept.

    Map only. A null or empty text has no words, fails the base rules and has llr 0. Input columns of
    the same names are replaced; repeated rows get the same verdict.
    """
    kept, schema = with_columns(docs, FIELDS)
    at, spark = len(kept), docs.sparkSession
    shared = spark.sparkContext.broadcast(ratio.weights)
    threshold = ratio.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            rows = []
            for text, hashes in zip(strings(b.column(at)), hashed_words(raw_bytes(b.column(at)), lower=False), strict=True):
                words = text.encode().split()
                n, llr, again = len(words), 0.0, 0
                if n:
                    ids: dict[bytes, int] = {}
                    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
                    again = repeated_words(codes)
                    llr = float(weights[features(hashes)].sum()) / (2 * n - 1)
                failed = n < 50 or 100 * again > 50 * n
                rows.append((n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines(text), again, failed, llr, not failed and llr >= threshold))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()], strict=True)] if rows else [pa.array([], t) for t in [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *columns], [*kept, *[f.name for f in FIELDS]])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias("_scored")).mapInArrow(run, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return apply_ratio(docs.select("doc_id", "text"), fit_ratio(docs, labels)).select("doc_id", *NUMBERS, "base_failed", "kept", "llr")
