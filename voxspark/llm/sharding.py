"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS = 24
SLOT_BLOCKS = 256


def _cost(key: Column, shard: int, weight: float) -> Column:
    """An exponential variate of rate `weight` fixed by key and shard; the smallest wins."""
    if weight <= 0:
        raise ValueError("weights must be positive")
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(unit) / F.lit(float(weight))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose draw for this key is the smallest; ties go to the lower shard."""
    return F.least(*[F.struct(_cost(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)])["shard"] if len(weights) > 1 else F.lit(0)


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0) -> DataFrame:
    """Adds shard, and grown_shard: the shard if one more of `grown_weight` is opened.

    No shuffle: each row needs its key alone. A key's draw for a shard does not
    depend on the other shards, so a new shard takes rows only into itself.
    Repeated keys go to one shard; a null key is a key like any other. Input
    columns called shard or grown_shard are replaced.
    """
    weights = list(weights)
    if not weights:
        raise ValueError("at least one shard is needed")
    k = F.col(key)
    return df.withColumns({"shard": winner(k, weights), "grown_shard": winner(k, [*weights, grown_weight])})


def with_slots(df: DataFrame, key: str = "doc_id", blocks: int = SLOT_BLOCKS) -> DataFrame:
    """Adds slot, gapless from 0 in each shard.

    Rows are numbered within (shard, block of the key's hash), and blocks by a
    running sum over their sizes (shards x blocks rows), so a shard is spread over `blocks`
    groups and none is sorted in one task. Repeated keys share a block, where rows that
    are alike in the other columns may swap numbers. An empty table stays empty.
    """
    order = F.struct(*[F.col(c) for c in (key, "size", "text_crc32") if c in df.columns])
    block = F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(blocks)).cast("int")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "slot"])
    rows = df.select(whole.alias("row"), F.col("shard"), block.alias("block"), order.alias("order"))
    sizes = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("shard", "block").orderBy("order")) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "block"]).select("row.*", (F.col("start") + F.col("i")).cast("long").alias("slot"))


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `key`: doc_id and shard count decide. Null text: size 8, CRC of no bytes."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).cast("long").alias("text_crc32"),
    )
    return with_slots(assign_shards(rows)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
