"""A corpus pipeline of five stages: quality rules, near-duplicate join, benchmark decontamination, mixing, sharding.

Each stage gets the whole table that its predecessor kept and the folder of the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxspark.llm.common import saved, table
from voxspark.llm.contamination import decontaminate
from voxspark.llm.jaccard import keep_one
from voxspark.llm.mixing import mix
from voxspark.llm.quality import apply_ratio, fit_ratio
from voxspark.llm.sharding import assign_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or the likelihood ratio go. Null texts go with them."""
    whole = docs.selectExpr("doc_id", "text", "struct(*) AS _doc")
    scored = apply_ratio(whole, fit_ratio(docs, table(spark, sf_dir, "labels")))
    return scored.where("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    return mix(docs, table(spark, sf_dir, "labels"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of every row, and its shard if one more is opened."""
    return assign_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Three stages (the fitted ratio, the mixing rates and the hash) are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
