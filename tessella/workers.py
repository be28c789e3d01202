"""Making this package importable in Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path; on a cluster it is installed or sent with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
