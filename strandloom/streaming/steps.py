"""Stateless steps over a stream of molecule tables: each file that arrives in a folder goes through the same plan.

Draws depend on the row's key only, so a stream gives what a batch run over the same rows gives, however they arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_packets(spark: SparkSession, path: str, schema) -> DataFrame:
    """Molecule packets in Parquet as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def process(molecules: DataFrame, steps: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs row steps on all that has arrived, writes Parquet, and ends; the next call goes on from there."""
    return steps(molecules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_quant(molecules: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Counts of each transcript so far, into a table of the session."""
    counts = molecules.groupBy("sample_id", "transcript_id").agg(F.count("*").alias("counts"))
    return counts.writeStream.format("memory").queryName(out).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
