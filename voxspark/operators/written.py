"""Tables written to the folder that driver and executors share, and read again: a plan then begins there, and a lost executor reads them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows may hold megabytes: row groups stay small, and their size is looked at after a few rows.
OPTIONS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4"}


def shared_folder(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; where it is unset, a temporary folder on one machine, and none on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    return f"file://{tempfile.mkdtemp(prefix='voxspark-')}" if spark.sparkContext.master.startswith("local") else None


def written(df: DataFrame, label: str) -> tuple[DataFrame, str | None]:
    """The rows read from a new table, and its path; where there is no shared folder, the rows as they are."""
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df, None
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.options(**OPTIONS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
