"""First and second strand synthesis: priming along the molecule, then the complement from the first prime on."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import rng
from strandloom.operators.molecules import piece
from strandloom.runtime import ship


def site_weights(sequence: str, ppm: np.ndarray) -> np.ndarray:
    """For each place the product of the probabilities of the bases of a primer there; other letters weigh 0."""
    codes = np.full(256, 4)
    codes[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    at = codes[np.frombuffer(sequence.encode(), np.uint8)]
    k = ppm.shape[1]
    w = np.ones(len(at) - k + 1)
    for j in range(k):
        w *= ppm[at[j : j + len(w)], j]
    return w


def prime_site(seed: int, step: str, ppm: dict[str, list[float]], primes_per_kb: float, expected: bool = False) -> Column:
    """The earliest (from 0) of some draws of places by weight, with one uniform number: the first place whose share of the
    weights up to it reaches 1 - (1 - u) ** (1 / primes); 0 if all weigh 0. The number of primes is binomial, and at least
    one; with expected it is its mean, rounded. Runs in Arrow batches."""
    matrix = np.array([*[ppm[b] for b in "ACGT"], [0.0] * len(ppm["A"])])
    ship()

    @F.pandas_udf("int")
    def site(key: pd.Series, sequence: pd.Series, u: pd.Series) -> pd.Series:
        out = []
        for k, s, x in zip(key, sequence, u, strict=True):
            if expected:
                primes = max(1.0, float(math.floor(len(s) * primes_per_kb / 1000.0 + 0.5)))
            else:
                primes = float(max(1, rng.generator(seed, f"{step}_primes", k).binomial(len(s), primes_per_kb / 1000.0)))
            c = np.cumsum(site_weights(s, matrix))
            out.append(int(np.searchsorted(c, (1 - (1 - x) ** (1 / primes)) * c[-1])) if c[-1] > 0 else 0)
        return pd.Series(out, dtype="int32")

    return site(F.col("row_key"), F.col("sequence"), rng.uniform(seed, step, F.col("row_key")))


def synthesize(df: DataFrame, seed: int, step: str, ppm: dict[str, list[float]], primes_per_kb: float = 50, perfect: bool = False, expected: bool = False) -> DataFrame:
    """The reverse complement of each molecule from its first prime on. Molecules shorter than the primer are lost.

    perfect: the site is always the first base. expected: the number of primes is its mean instead of a draw.
    """
    k = len(next(iter(ppm.values())))
    df = df.filter(F.length("sequence") >= k)
    site = F.lit(0) if perfect else prime_site(seed, step, ppm, primes_per_kb, expected)
    df = df.withColumn("_site", site)
    return piece(df, F.col("_site") + 1, F.length("sequence") - F.col("_site"), F.lit(".cdna"), reverse=True).drop("_site")


def first_strand(df: DataFrame, seed: int, ppm: dict[str, list[float]], **options) -> DataFrame:
    return synthesize(df, seed, "first_strand", ppm, **options)


def second_strand(df: DataFrame, seed: int, ppm: dict[str, list[float]], **options) -> DataFrame:
    return synthesize(df, seed, "second_strand", ppm, **options)
