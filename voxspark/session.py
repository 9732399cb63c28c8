"""Ships this package to the executors of a session whose workers may not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of every executor, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_voxspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = os.path.join(tempfile.mkdtemp(prefix="voxspark-"), "voxspark_src.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(name)
    sc._voxspark_shipped = True
