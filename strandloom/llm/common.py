"""Pieces the training-data operators share: input normalisation, scratch tables, numpy helpers, connected components.

Scratch tables live under ``spark.checkpoint.dir``, which a cluster names and all executors share. Only where that
setting is absent and all is one process (tests) a temporary folder of this machine is used.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import runtime
from strandloom.sources.scratch import base_folder

#: Rows in one Arrow batch: whole texts are long, and both sides hold a batch in memory.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Bounds Arrow batches, and lets Python workers import this package where the driver got it from a source tree (a cluster gets it installed or by --py-files)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    runtime.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string; other columns, whatever their names, don't take part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold_remainder(column: str, modulus: int):
    """crc32 of the id written as text, modulo: the fold that labels are held out by."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)).cast("int")


class Scratch:
    """Tables written to the shared checkpoint folder to cut lineage; a lost executor then loses nothing that can't be read again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{base_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, parts: int | None = None) -> tuple[DataFrame, str]:
        """Writes df, in at most so many parts where its size is known, and returns it reread, with its path."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        (df.coalesce(parts) if parts else df).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        """Deletes a table that nothing reads any more."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; for integers far faster than np.unique."""
    if not len(x):
        return x
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on each input bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def unit_floats(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    starts = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(starts, counts)


#: Ids up to so many (8 bytes each) are sent to all executors, so that texts needn't move; beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, scratch: Scratch, digest: Column | None = None) -> DataFrame:
    """docs whose doc_id isn't among the ids (doc_id), or, with a digest of their text, whose doc_id and digest aren't (doc_id, digest). Rows without an id stay."""
    keys = ["doc_id"] if digest is None else ["doc_id", "digest"]
    ids, _ = scratch.keep(ids.select(*keys).distinct().toDF(*[f"_{k}" for k in keys]))
    own = [F.col("doc_id"), digest][: len(keys)]
    same = reduce(Column.__and__, [a == F.col(f"_{k}") for a, k in zip(own, keys, strict=True)])
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, same, "left_anti").select(*docs.columns)


#: Edges in one part of a written table.
EDGES_PART = 250_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): root is the smallest node reachable over edges (u, v). Nodes without edges don't appear.

    Alternating large-star and small-star steps. Each holds as many edges as it got or fewer, groups are reduced by
    partial minima, which are written so that a node with very many neighbours is met by a join that adaptive execution can split.
    Ends when a round changes nothing; ends at once on an empty input.
    """
    edges = edges.filter("u <> v and u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = scratch.keep(edges)
    mark = _mark(now)
    while mark[0]:
        parts = 1 + mark[0] // EDGES_PART  # no step makes more edges than it has
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, first = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), parts)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, second = scratch.keep(large, parts)
        low, third = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), parts)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now, later = scratch.keep(small, parts)
        for old in (path, first, second, third):
            scratch.drop(old)
        path, before, mark = later, mark, _mark(now)
        if mark == before:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return (row[0], row[1])
