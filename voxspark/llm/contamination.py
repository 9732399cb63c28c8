"""Benchmark decontamination: size-partitioned MinHash containment, verified by exact shingle containment.

A document holds an item if it holds at least THRESHOLD of the item's distinct five-word shingles. Items are
partitioned by size (powers of two); an item's signature is its bottom-k MinHash sketch, with k one
more than the shingles that an item at its partition's upper bound may lack. By the
pigeonhole principle, every document that holds the item has one of those k minima among its own
shingles, however long it is, so no pair is lost. On the document side only shingles whose hash is
within the partitions' largest minimum are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SHINGLE, native_words, saved, table, unused

PERCENT = 75
BROADCAST_ROWS = 1_000_000


def _positions(df: DataFrame, key: str) -> DataFrame:
    """key, words, i: a row for each shingle's first word; none for a text without words."""
    words = df.select(F.col(key), native_words(F.lower("text")).alias("words"))
    last = F.greatest(F.size("words") - SHINGLE, F.lit(0))
    return words.select(key, "words", F.explode(F.when(F.size("words") > 0, F.sequence(F.lit(0), last))).alias("i"))


def _window() -> list[Column]:
    return [F.get("words", F.col("i") + k) for k in range(SHINGLE)]


def shingle_keys(df: DataFrame, key: str) -> DataFrame:
    return _positions(df, key).select(key, F.xxhash64(*_window()).alias("h"))


def shingle_texts(df: DataFrame, key: str) -> DataFrame:
    return _positions(df, key).select(key, F.concat_ws(" ", *_window()).alias("gram"))


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, h: the bottom-k MinHash sketch of every item, k by the size partition."""
    keys = shingle_keys(items, "item_id").distinct()
    sized = keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    k = F.floor(upper * (100 - percent) / 100) + 1
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h")))
    return ranked.where(F.col("rank") <= k).select("item_id", "h")


def _small(df: DataFrame, n: int) -> DataFrame:
    """For a broadcast where its counted rows are within the bound; otherwise the join shuffles."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, hits, item_shingles, containment: every document and item at `percent` or more.

    Words are lower-cased and cut at white space. An item of fewer than five words is one shingle, its whole sequence, and
    so found only in a document that is that sequence. Items or documents without
    words match nothing. Rows of one doc_id (or item_id), null included, count as one text; repeated rows
    change nothing; empty tables give no rows.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    sketch = saved(sketches(items, percent), "sketches")
    n, most = sketch.agg(F.count(F.lit(1)), F.max("h")).first()
    if not n:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, hits long, item_shingles long, containment double")
    probes = shingle_keys(docs, "doc_id").where(F.col("h") <= F.lit(most))
    pairs = saved(probes.join(_small(sketch, n), "h").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("minima")), "candidates")
    some = pairs.select(F.col("doc_id").alias("_d")).distinct()
    found = docs.join(_small(some, some.count()), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    grams = saved(shingle_texts(items, "item_id").distinct(), "item-shingles")
    sizes = grams.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_shingles"))
    hits = shingle_texts(found, "doc_id").join(_small(grams, grams.count()), "gram").groupBy("doc_id", "item_id", "gram").agg(F.lit(1).alias("one"))
    counted = hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("hits"))
    s = sizes.withColumnRenamed("item_id", "_i")
    joined = counted.join(s, F.col("item_id").eqNullSafe(F.col("_i"))).drop("_i").where(F.col("hits") * 100 >= F.col("item_shingles") * percent)
    return joined.select("doc_id", "item_id", "hits", "item_shingles", (F.col("hits") / F.col("item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no item, all columns as they were; a null doc_id that holds one takes all null ids along."""
    own = unused(docs.columns, "_bad")
    bad = saved(contaminated(docs, items, percent).select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    return docs.join(_small(bad, bad.count()), F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = """SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name})"""
ORACLE = f"""
WITH i AS (SELECT DISTINCT * FROM ({_SHINGLES.format(key="item_id", name="benchmark")})),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY 1),
d AS (SELECT DISTINCT * FROM ({_SHINGLES.format(key="doc_id", name="documents")})),
h AS (SELECT doc_id, item_id, count(*) AS hits FROM d JOIN i USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, hits, item_shingles, CAST(hits AS DOUBLE) / item_shingles AS containment
FROM h JOIN n USING (item_id) WHERE hits * 100 >= item_shingles * {PERCENT}
"""
