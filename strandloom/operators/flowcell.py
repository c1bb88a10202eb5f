"""The flowcell: molecules become clusters with a lane and coordinates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import rng


@dataclass(frozen=True)
class Geometry:
    """Ranges, both ends included."""

    tile: tuple[int, int] = (1101, 2228)
    x: tuple[int, int] = (1012, 32816)
    y: tuple[int, int] = (998, 49247)
    lanes: tuple[int, ...] = (1, 2)

    def sizes(self) -> tuple[int, int, int]:
        return tuple(b - a + 1 for a, b in (self.x, self.y, self.tile))


def ranked(df: DataFrame) -> DataFrame:
    """_rn: place (from 1) in the order of a packet; _n: size of the packet. A packet is a bounded unit."""
    w = Window.partitionBy("sample_id", "packet_id")
    return df.withColumns({"_rn": F.row_number().over(w.orderBy("ordinal", "row_key")), "_n": F.count("*").over(w)})


def lane_index(rn: Column, n: Column, lanes: int) -> Column:
    """Contiguous blocks by order. Blocks start one early, so of ten in two lanes four and six; fewer than lanes go round."""
    block = F.greatest(F.lit(1), F.floor(n / F.lit(lanes)))
    return F.when(n < lanes, rn % lanes).otherwise(F.least(F.lit(lanes - 1), F.floor(rn / block))).cast("int")


def assign_lanes(df: DataFrame, lanes: tuple[int, ...]) -> DataFrame:
    """lane, and cluster_id counted from 1 in each packet."""
    out = ranked(df)
    lane = F.array(*[F.lit(x) for x in lanes])[lane_index(F.col("_rn"), F.col("_n"), len(lanes))]
    return out.withColumns({"lane": lane, "cluster_id": F.col("_rn").cast("bigint")}).drop("_rn", "_n")


def random_coordinates(df: DataFrame, seed: int, g: Geometry) -> DataFrame:
    """Independent draws; two clusters may share a place."""
    draw = lambda name, span: rng.integer(rng.uniform(seed, "flowcell", F.col("row_key"), name), *span)
    return df.withColumn("coordinates", F.struct(draw("tile", g.tile).cast("int").alias("tile"), draw("x", g.x).cast("int").alias("x"), draw("y", g.y).cast("int").alias("y")))


def places(seed: int, g: Geometry) -> tuple[int, int]:
    """Step and shift of the permutation of all places: number times step plus shift, modulo the number of places."""
    size = math.prod(g.sizes())
    step = int(rng.uniform_py(seed, "flowcell_step") * size) | 1
    while math.gcd(step, size) != 1:
        step += 2
    return step, int(rng.uniform_py(seed, "flowcell_shift") * size)


def distinct_coordinates(df: DataFrame, seed: int, g: Geometry) -> DataFrame:
    """No two clusters share a place, in any packet: each one's number is mapped by a permutation of all places.

    Numbers are the places in a packet after the sizes of the packets before it, so no task sees more than a packet, and the
    sums run over the packets only. More rows than places are an error.
    """
    sx, sy, st = g.sizes()
    size = sx * sy * st
    packets = df.groupBy("sample_id", "packet_id").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy("sample_id", "packet_id").rowsBetween(Window.unboundedPreceding, -1))
    packets = packets.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("_k").over(Window.partitionBy())})
    total = packets.agg(F.max("_all")).first()[0] or 0
    if total > size:
        raise ValueError(f"{total} clusters don't fit {size} places")
    step, shift = places(seed, g)
    out = ranked(df).join(packets.select("sample_id", "packet_id", "_before"), ["sample_id", "packet_id"])
    number = (F.col("_before") + F.col("_rn") - 1).cast("decimal(38,0)")
    at = ((number * F.lit(step).cast("decimal(19,0)") + F.lit(shift)) % F.lit(size)).cast("bigint")
    out = out.withColumn("_at", at)
    place = F.struct(
        (F.lit(g.tile[0]) + F.floor(F.col("_at") / (sx * sy))).cast("int").alias("tile"),
        (F.lit(g.x[0]) + F.col("_at") % sx).cast("int").alias("x"),
        (F.lit(g.y[0]) + F.floor(F.col("_at") / sx) % sy).cast("int").alias("y"),
    )
    return out.withColumn("coordinates", place).drop("_rn", "_n", "_before", "_at")


def load(df: DataFrame, seed: int, g: Geometry, strategy: str = "random") -> DataFrame:
    """Clusters: molecules with lane, cluster_id, coordinates and a molecule count of 1."""
    placed = (distinct_coordinates if strategy == "distinct" else random_coordinates)(assign_lanes(df, g.lanes), seed, g)
    return placed.withColumns({"molecule_count": F.lit(1).cast("bigint"), "diameter": F.lit(0)})


def sort_packets(df: DataFrame) -> DataFrame:
    """Clusters of each packet in the order of their coordinates, without a global sort."""
    return df.repartition("sample_id", "packet_id").sortWithinPartitions("sample_id", "packet_id", "coordinates.tile", "coordinates.x", "coordinates.y")
