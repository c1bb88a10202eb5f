"""Fragmentation: each bond may break."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import rng
from strandloom.operators.molecules import piece
from strandloom.runtime import ship


def break_probability(rate: float, runtime: float) -> float:
    return -math.expm1(-rate * runtime)


def cut(df: DataFrame, breaks: Column, min_size: int) -> DataFrame:
    """Pieces between breaks (an ordered array of numbers of bases before the break), those of the least size or more."""
    n = F.length("sequence")
    ends = F.concat(breaks, F.array(n))
    starts = F.concat(F.array(F.lit(0)), breaks)
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), i.alias("k")))
    kept = F.filter(pieces, lambda p: (p["b"] - p["a"] >= min_size) & (p["b"] > p["a"]))
    out = df.withColumn("_p", F.explode(kept))
    return piece(out, F.col("_p.a") + 1, F.col("_p.b") - F.col("_p.a"), F.concat(F.lit(".f"), F.col("_p.k").cast("string"))).drop("_p")


def uniform_breaks(seed: int, probability: float) -> Column:
    """Every bond breaks on its own with the same probability."""
    n = F.length("sequence")
    bonds = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n - 1))
    return F.filter(bonds, lambda i: rng.uniform(seed, "fragment", F.col("row_key"), i) < probability)


def fragment_uniform(df: DataFrame, seed: int, rate: float, runtime: float, min_size: int) -> DataFrame:
    return cut(df, uniform_breaks(seed, break_probability(rate, runtime)), min_size)


def fragment_beta(df: DataFrame, seed: int, rate: float, runtime: float, min_size: int, a: float, b: float, n: float) -> DataFrame:
    """Breaks come at exponential times; their rate grows with the bonds to the power n, their place is beta distributed.

    The pieces go on with the time that is left. Draws come from a generator of the row's own, in Arrow batches.
    """
    breaks = "_breaks"
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, size in zip(pdf["row_key"], pdf["sequence"].str.len(), strict=True):
                g, found, todo = rng.generator(seed, "fragment_beta", key), [], [(0, int(size), float(runtime))]
                while todo:
                    begin, end, left = todo.pop()
                    bonds = end - begin - 1
                    if bonds < 1:
                        continue
                    wait = g.exponential(1.0 / (rate * bonds**n / 1000.0 ** (n - 1)))
                    if wait < left:
                        at = begin + 1 + min(bonds - 1, int(g.beta(a, b) * bonds))
                        found.append(at)
                        todo += [(begin, at, left - wait), (at, end, left - wait)]
                out.append(sorted(found))
            yield pdf.assign(**{breaks: out})

    return cut(df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(breaks, T.ArrayType(T.IntegerType()))])), F.col(breaks), min_size).drop(breaks)
