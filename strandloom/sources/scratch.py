"""Folders for intermediate files, under the shared folder that a cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def base_folder(spark: SparkSession) -> str:
    """The shared folder. A temporary folder of this machine serves only where driver and executors are one process; elsewhere executors
    would each write to a disk of their own, so an unset spark.checkpoint.dir is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
    return Path(tempfile.gettempdir()).as_uri()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
