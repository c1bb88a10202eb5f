"""What runs on executors must be able to import this package."""

from __future__ import annotations

import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession | None = None) -> None:
    """Lets Python workers import the package where the driver got it from a source tree; a cluster gets it installed or by --py-files."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or not any(os.path.abspath(p or ".") == ROOT for p in sys.path):
        return
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, ROOT])
