"""Steps that keep or shorten molecules: polyA selection, size selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import rng
from strandloom.functions.sequence import polya_tail_length
from strandloom.operators.molecules import piece


def counted_tail(min_tail: int) -> Column:
    """The tail's length, 0 unless it is longer than the minimum."""
    tail = polya_tail_length("sequence")
    return F.when(tail > min_tail, tail).otherwise(0)


def polya_odds(min_prob: float = 0.0, max_prob: float = 1.0, min_tail: int = 40, per_base: float = 0.05) -> Column:
    return F.least(F.lit(float(min_prob)) + F.lit(float(per_base)) * counted_tail(min_tail), F.lit(float(max_prob)))


def polya_select(df: DataFrame, seed: int, min_prob: float = 0.0, max_prob: float = 1.0, min_tail: int = 40, per_base: float = 0.05) -> DataFrame:
    """Keeps a molecule with odds that rise with its tail."""
    return df.filter(rng.uniform(seed, "polya", F.col("row_key")) <= polya_odds(min_prob, max_prob, min_tail, per_base))


def polya_break(df: DataFrame, seed: int, break_prob: float, min_tail: int = 40) -> DataFrame:
    """Breaks molecules at a geometric distance from the tail; what lies before the break is lost."""
    if not break_prob:
        return df
    n, tail = F.length("sequence"), counted_tail(min_tail)
    b = rng.geometric(rng.uniform(seed, "polya_break", F.col("row_key")), break_prob)
    first = F.when(b < n - tail, n - tail - b + 1).otherwise(F.lit(1))
    return piece(df, first, n - first + 1)


def size_probability(n: Column, min_length: int, max_length: int, full_from: int | None = None, full_to: int | None = None) -> Column:
    """1 on the plateau, linear ramps beside it, 0 outside. Without a plateau the limits are its ends."""
    low, high = full_from or min_length, full_to or max_length
    up = (n - min_length) / F.lit(float(max(1, low - min_length)))
    down = (F.lit(max_length) - n) / F.lit(float(max(1, max_length - high)))
    return F.when((n < min_length) | (n > max_length), 0.0).when((n >= low) & (n <= high), 1.0).when(n < low, up).otherwise(down)


def size_select(df: DataFrame, seed: int, min_length: int, max_length: int, full_from: int | None = None, full_to: int | None = None) -> DataFrame:
    """Keeps a molecule by the probability of its length; on the plateau always."""
    # the length is bound once: a filter would take an expression behind it anew for each use
    p = F.transform(F.array(F.length("sequence")), lambda n: size_probability(n, min_length, max_length, full_from, full_to))[0]
    return df.filter(rng.uniform(seed, "sizing", F.col("row_key")) < p)
